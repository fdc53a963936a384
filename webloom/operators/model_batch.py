"""Batch model-extraction I/O (F16, L1-L3, A6): request tables out, response tables back in.

The model call itself happens outside (an offline batch endpoint); these operators build the
request rows from a corpus and parse whatever responses come back, all as native Column work."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.text import chunk_starts, llm_prompt, truncate_tokens


def schema_json(schema: T.StructType, title: str = "Item") -> str:
    """JSON schema text for a flat StructType (properties + required), pretty-printed."""
    tmap = {T.StringType: "string", T.IntegerType: "integer", T.LongType: "integer", T.DoubleType: "number",
            T.FloatType: "number", T.BooleanType: "boolean"}
    props, req = {}, []
    for f in schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            props[f.name] = {"items": {"type": tmap.get(type(f.dataType.elementType), "string")}, "title": f.name.title(),
                             "type": "array"}
        else:
            props[f.name] = {"title": f.name.replace("_", " ").title(), "type": tmap.get(type(f.dataType), "string")}
        if not f.nullable:
            req.append(f.name)
    return json.dumps({"properties": props, "required": req, "title": title, "type": "object"}, indent=2)


def llm_requests(docs: DataFrame, key: str, text: str, schema: T.StructType, instruction: str | None = None,
                 fmt: str = "markdown", chunk_threshold: int = 4000, overlap: int = 200, max_tokens: int = 4000) -> DataFrame:
    """L1: one request per (doc, chunk): content chunked (F14), truncated (F13), prompts (F16). Chunks must fit in
    ``max_tokens``: text that one request cut would be in no other."""
    if max_tokens < chunk_threshold:
        raise ValueError("max_tokens must be at least chunk_threshold")
    size = chunk_threshold * 4
    ch = docs.select(key, text, F.posexplode(chunk_starts(text, chunk_threshold, overlap)).alias("chunk_idx", "start"))
    content = truncate_tokens(F.substring(text, F.col("start") + 1, size), max_tokens)
    system, user = llm_prompt(content, schema_json(schema), instruction, fmt)
    return ch.select(key, "chunk_idx", system.alias("system_prompt"), user.alias("user_prompt"))


def _string_leaves(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.ArrayType(T.StringType()) if isinstance(f.dataType, T.ArrayType)
                                       else T.StringType()) for f in schema.fields])


def parse_responses(resp: DataFrame, schema: T.StructType, key_cols=("doc_id", "chunk_idx"),
                    response: str = "response") -> DataFrame:
    """L2: items from ``{"items": [...]}``, else ``{"data": [...]}``, else a bare array, else the
    object itself; leaves read as strings then cast per schema (numeric strings accepted); records
    missing a required field are dropped.  Unparsable responses give no rows (see ``response_errors``)."""
    leaves = _string_leaves(schema)
    arr = T.ArrayType(leaves)
    wrapped = T.StructType([T.StructField("items", arr), T.StructField("data", arr)])
    r = F.col(response)
    obj = F.from_json(r, wrapped)
    items = F.coalesce(obj["items"], obj["data"], F.from_json(r, arr))
    keys = [k for k in key_cols if k in resp.columns]
    out = resp.select(*keys, F.posexplode(items).alias("item_idx", "it"))
    cols = []
    for f in schema.fields:
        c = F.col("it")[f.name]
        if isinstance(f.dataType, T.ArrayType):
            c = F.transform(c, lambda x, dt=f.dataType.elementType: x.try_cast(dt))
        elif not isinstance(f.dataType, T.StringType):
            c = c.try_cast(f.dataType)
        cols.append(c.alias(f.name))
    out = out.select(*keys, "item_idx", *cols)
    present = None
    for f in schema.fields:
        p = F.col(f.name).isNotNull()
        present = p if present is None else (present | p)
    out = out.where(present)
    for f in schema.fields:
        if not f.nullable:
            out = out.where(F.col(f.name).isNotNull())
    return out


def response_errors(resp: DataFrame, response: str = "response") -> DataFrame:
    """Responses that are not JSON at all."""
    return resp.where(F.try_parse_json(F.col(response)).isNull())


TABLE_SCHEMA = T.StructType([T.StructField("headers", T.ArrayType(T.StringType()), False),
                             T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())), False),
                             T.StructField("caption", T.StringType(), True)])


def tables_from_responses(resp: DataFrame, response: str = "response") -> DataFrame:
    """L3: table records (headers, rows, caption) per (doc, chunk)."""
    r = F.col(response)
    arr = T.ArrayType(TABLE_SCHEMA)
    wrapped = T.StructType([T.StructField("items", arr), T.StructField("data", arr)])
    obj = F.from_json(r, wrapped)
    items = F.coalesce(obj["items"], obj["data"], F.from_json(r, arr))
    out = resp.select("doc_id", "chunk_idx", F.posexplode(items).alias("item_idx", "t"))
    return out.where(F.col("t.headers").isNotNull() & F.col("t.rows").isNotNull()).select(
        "doc_id", "chunk_idx", "item_idx", "t.headers", "t.rows", "t.caption")


def merge_tables(tables: DataFrame) -> DataFrame:
    """A6, long form: per document, tables with an identical header list merge into one table whose
    rows are appended in (chunk, item) order; the first table's caption is kept; tables are numbered
    in first-seen order.  -> (doc_id, headers, first_chunk, first_item, caption, chunk_idx, item_idx,
    row_idx, row).  Only partial aggregates and a join: no table is collected into one row."""
    first = (tables.groupBy("doc_id", "headers")
             .agg(F.min(F.struct("chunk_idx", "item_idx")).alias("f"),
                  F.min_by("caption", F.struct("chunk_idx", "item_idx")).alias("caption"))
             .select("doc_id", "headers", F.col("f.chunk_idx").alias("first_chunk"),
                     F.col("f.item_idx").alias("first_item"), "caption"))
    rows = tables.select("doc_id", "headers", "chunk_idx", "item_idx", F.posexplode("rows").alias("row_idx", "row"))
    return first.join(rows, ["doc_id", "headers"])


def merge_tables_nested(merged: DataFrame) -> DataFrame:
    """A6 as nested tables (one row per merged table) for consumers that need the nested shape;
    bounded by one document's tables."""
    g = merged.groupBy("doc_id", "headers", "first_chunk", "first_item", "caption").agg(
        F.array_sort(F.collect_list(F.struct("chunk_idx", "item_idx", "row_idx", "row"))).alias("rs"))
    return g.select("doc_id", "headers", "first_chunk", "first_item", "caption",
                    F.transform("rs", lambda r: r["row"]).alias("rows"))
