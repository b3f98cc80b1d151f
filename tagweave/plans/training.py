"""From an annotated corpus to training and validation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators import linearize, projections, sampling
from tagweave.sources import row_index


def build_dataset(df: DataFrame, cfg: linearize.LinearizeConfig, experiment: str, id_col: str, seed: int = 0, batch: int | None = 1000) -> DataFrame:
    """Rows by experiment: "with_tags" (v1 or annotated tables, types drawn by cfg.sample_weights or by inverse
    frequency), "with_tags_all" (drawn only if cfg.random_sample is set) or "without_tags".

    Without tags the texts of `batch` documents in a row, by id_col (None: of all documents), are joined and
    cut into blocks of cfg.max_seq_len; what is left of such a group at its end is dropped, or padded if it is
    all there is. Columns: group, block_idx, input_ids, attention_mask.
    """
    src = projections.drop_empty_text(df)
    if experiment == "without_tags":
        ids = F.transform(linearize.regex_tokens("text"), lambda t: t["id"])
        coded = src.select(F.col(id_col).alias("_o"), ids.alias("ids"))
        if batch is None:
            coded = coded.withColumn("group", F.lit(0).cast("long"))
        else:
            coded = row_index(coded, "_o").withColumn("group", F.floor(F.col("_rn") / batch)).drop("_rn")
        return linearize.pack(coded, cfg.max_seq_len, "group", "_o", pad_id=cfg.pad_id)
    if experiment not in ("with_tags", "with_tags_all"):
        raise ValueError(f"no experiment {experiment!r}")
    if cfg.html_rate < 1 and "tags_html" in src.columns:
        src = sampling.drop_html(src, cfg.html_rate, seed, id_col)
    v1 = projections.to_v1(src, cfg.tags_columns)
    if experiment == "with_tags" or cfg.random_sample:
        weights = cfg.sample_weights
        if weights is None:  # a row a node type comes to the driver
            some = v1 if cfg.sample_size is None else v1.orderBy(id_col).limit(cfg.sample_size)
            weights = {r["key"]: r["weight"] for r in sampling.type_weights(sampling.type_counts(some)).collect()}
        v1 = sampling.sample_tags(v1, weights, seed, id_col)
    return linearize.train_rows(v1, cfg, id_col, seed)
