"""Explicit schemas: reading with them saves the extra scan that inference costs."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()

VERSION = T.StructType([T.StructField("version", _S), T.StructField("created", _S)])

PAPER = T.StructType(
    [T.StructField(n, _S) for n in (
        "id", "title", "abstract", "categories", "update_date", "authors",
        "submitter", "doi", "license", "journal-ref", "report-no")]
    + [T.StructField("authors_parsed", T.ArrayType(T.ArrayType(_S))),
       T.StructField("versions", T.ArrayType(VERSION))]
)

REFERENCES = T.StructType([T.StructField("src", _S), T.StructField("refs", T.ArrayType(_S))])
CATEGORY_MAP = T.StructType([T.StructField(n, _S) for n in ("category_id", "pretty_name", "group_name")])
EDGE = T.StructType([T.StructField("src", _S), T.StructField("dst", _S)])
CLEAN_DOC = T.StructType([T.StructField(n, _S) for n in ("id", "label_str", "text_clean", "update_date")])
LEMMA_DOC = T.StructType([T.StructField("id", _S), T.StructField("text", _S)])
EMBEDDING = T.StructType([T.StructField("id", _S), T.StructField("embedding", T.ArrayType(T.FloatType()))])
