"""tagweave: tags annotation and training-row preparation for web-text corpora on Spark."""
