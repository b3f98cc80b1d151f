"""Node types and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

GLOBAL = "struct<key:string,type:string,value:string>"
LOCAL = "struct<char_end_idx:bigint,char_start_idx:bigint,key:string,type:string,value:string>"
LOCAL_REL = (
    "struct<char_end_idx:bigint,char_start_idx:bigint,key:string,"
    "relative_end_pos:bigint,relative_start_pos:bigint,type:string,value:string>"
)
HTML = (
    "struct<char_end_idx:bigint,char_start_idx:bigint,html_attrs:struct<attrs:array<string>,values:array<string>>,"
    "key:string,relative_end_pos:bigint,relative_start_pos:bigint,type:string,value:string>"
)
PARAGRAPH = "struct<char_end_idx:bigint,char_start_idx:bigint,key:string,marker:string,type:string,value:string>"
#: Every field that some node type has; missing ones are null.
ANY = (
    "struct<char_end_idx:bigint,char_start_idx:bigint,html_attrs:struct<attrs:array<string>,values:array<string>>,"
    "key:string,marker:string,relative_end_pos:bigint,relative_start_pos:bigint,type:string,value:string>"
)

#: Column and node type of the annotated corpus.
ANNOTATIONS = {
    "tags_entity": LOCAL,
    "tags_entity_paragraph": LOCAL_REL,
    "tags_generation_datasource": GLOBAL,
    "tags_generation_length_sentence": LOCAL,
    "tags_generation_length_text": GLOBAL,
    "tags_html": HTML,
    "tags_paragraph": PARAGRAPH,
    "tags_timestamp": GLOBAL,
    "tags_title": GLOBAL,
    "tags_url": GLOBAL,
    "tags_website_desc": GLOBAL,
}
V2 = ", ".join(
    [
        "c4_shard bigint, c4_timestamp string, html string, text string, url string",
        "html_footer array<string>, html_head array<string>, html_title array<string>",
        "html_error bigint, html_error_comment string",
        *(f"{name} array<{node}>" for name, node in ANNOTATIONS.items()),
    ]
)
V1 = f"id string, text string, tags array<{ANY}>"
TRAIN_ROW = "chunk_idx int, input_ids array<int>, attention_mask array<int>, tags_mask array<int>"

_SCALARS = {"int64": "bigint", "int32": "int", "string": "string", "float64": "double", "float32": "float", "bool": "boolean"}


def schema_from_spec(spec: object) -> T.DataType:
    """A nested spec to a type: a scalar's name, a one-element list of a spec, or a dict of specs.

    {"dtype": name} is a scalar too. The fields of a dict keep their order. Spark's own JSON form of a
    schema, which has "fields", is taken as it is.
    """
    if isinstance(spec, str):
        return T._parse_datatype_string(_SCALARS.get(spec, spec))
    if isinstance(spec, list):
        if len(spec) != 1:
            raise ValueError("a list spec holds the spec of its elements")
        return T.ArrayType(schema_from_spec(spec[0]))
    if not isinstance(spec, dict):
        raise TypeError(f"not a schema spec: {spec!r}")
    if "fields" in spec and spec.get("type") == "struct":
        return T.StructType.fromJson(spec)
    if isinstance(spec.get("dtype"), str):
        return schema_from_spec(spec["dtype"])
    return T.StructType([T.StructField(name, schema_from_spec(kind)) for name, kind in spec.items()])
