"""Catalogue operators: decoding, collapsing, reconciling, merging, auditing."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode_columnar(documents: DataFrame, text: str, columns: dict[str, str]) -> DataFrame:
    """Rows of ``{"columns": [...], "rows": [[...]]}`` documents; columns a document lacks
    are null, unreadable documents give no rows."""
    x = F.from_json(text, "columns array<string>, rows array<array<string>>")
    d = documents.select(x.alias("x")).select("x.columns", F.explode("x.rows").alias("row"))
    at = {c: F.array_position("columns", c).cast("int") for c in columns}
    return d.select(*[F.when(at[c] > 0, F.try_element_at("row", F.when(at[c] > 0, at[c]).otherwise(F.lit(1)))).try_cast(t).alias(c) for c, t in columns.items()])


def collapse(df: DataFrame, key: list[str], order: list[Column], counted: Column) -> DataFrame:
    """One row per key, the least by ``order``, with the number of rows where ``counted``
    holds; a grouping, so that copies shrink before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    g = df.groupBy(*key).agg(F.min(F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("r"))).alias("b"), F.count_if(counted).alias("n_variants"))
    return g.select(*key, "b.r.*", "n_variants")


def unique_prefix_length(ids: DataFrame, id_col: str, least: int, most: int) -> DataFrame:
    """Shortest prefix length that keeps all distinct ids apart (null if none does): every
    length is counted in one aggregation."""
    n = ids.select(id_col).distinct().agg(F.count("*").alias("n"), *[F.count_distinct(F.left(F.col(id_col), F.lit(k))).alias(f"k{k}") for k in range(least, most + 1)])
    return n.select("n", F.coalesce(*[F.when(F.col(f"k{k}") == F.col("n"), F.lit(k)) for k in range(least, most + 1)]).alias("prefix_length"))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters, no closing slash."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    head, query = F.split_part(bare, F.lit("?"), F.lit(1)), F.substring_index(bare, "?", -1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~F.lower(p).rlike("^(utm_[a-z]+|gclid|fbclid|ref)=")), "&")
    host = F.regexp_extract(head, "^[A-Za-z]+://[^/]*", 0)
    path = F.regexp_replace(F.substr(head, F.length(host) + 1), "/+$", "")
    return F.concat(F.lower(host), path, F.when(F.contains(bare, F.lit("?")) & (kept != ""), F.concat(F.lit("?"), kept)).otherwise(""))


def upc_e_to_a(code: Column) -> Column:
    """The 12 digits of an 8-digit UPC-E, by its last but one digit; null for other texts."""
    s = lambda a, n: F.substring(code, a, n)
    last = s(7, 1)
    body = (
        F.when(last.isin("0", "1", "2"), F.concat(s(2, 2), last, F.lit("0000"), s(4, 3))).when(last == "3", F.concat(s(2, 3), F.lit("00000"), s(5, 2)))
        .when(last == "4", F.concat(s(2, 4), F.lit("00000"), s(6, 1))).otherwise(F.concat(s(2, 5), F.lit("0000"), last))
    )
    return F.when(code.rlike("^[01][0-9]{7}$"), F.concat(s(1, 1), body, s(8, 1)))


@F.pandas_udf(T.StructType([T.StructField("payload", T.StringType()), T.StructField("sha", T.StringType())]))
def encode_keys(keys: pd.Series) -> pd.DataFrame:
    """Sorted distinct keys, compressed as text, with the digest of the list."""
    out = []
    for k in keys:
        raw = json.dumps(sorted({str(x) for x in (k if k is not None else []) if x is not None})).encode()
        out.append((base64.b64encode(zlib.compress(raw, 9)).decode(), hashlib.sha256(raw).hexdigest()))
    return pd.DataFrame(out, columns=["payload", "sha"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def decode_keys(payload: pd.Series, sha: pd.Series) -> pd.Series:
    """The keys, or null where the payload isn't what was encoded."""

    def one(p, s):
        try:
            raw = zlib.decompress(base64.b64decode(p, validate=True))
            return json.loads(raw) if hashlib.sha256(raw).hexdigest() == s else None
        except (ValueError, TypeError, zlib.error):
            return None

    return pd.Series([one(p, s) for p, s in zip(payload, sha, strict=True)])


def reconcile(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """Every key of any side with the sides that hold it: one grouping of the tagged union."""
    tagged = None
    for name, df in sides.items():
        t = df.select(F.col(key), F.lit(name).alias("side")).where(F.col(key).isNotNull())
        tagged = t if tagged is None else tagged.unionByName(t)
    return tagged.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("side")), ",").alias("held_by"))


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """``existing`` with the rows of ``incoming`` put over it, and what happened to each row."""
    e = existing.select(*key, F.struct(*values).alias("e"))
    i = incoming.select(*key, F.struct(*values).alias("i"))
    j = e.join(i, key, "full_outer")
    what = F.when(F.col("e").isNull(), "inserted").when(F.col("i").isNull() | F.col("e").eqNullSafe(F.col("i")), "kept").otherwise("updated")
    return j.select(*key, F.coalesce("i", "e").alias("v"), what.alias("outcome")).select(*key, "v.*", "outcome")


def episodes(rows: DataFrame, key: list[str], at: str, priced: Column) -> DataFrame:
    """First and last sight of every key, and since when it has had a price."""
    return rows.groupBy(*key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.min(F.when(priced, F.col(at))).alias("priced_since"), F.count_if(~priced).alias("n_unpriced"))


def group_conflicts(members: DataFrame, group: str, attributes: list[str]) -> DataFrame:
    """Attributes with more than one value in a group, from extremes instead of pairs."""
    g = members.groupBy(group).agg(F.count("*").alias("n"), *[F.min(a).alias(f"lo_{a}") for a in attributes], *[F.max(a).alias(f"hi_{a}") for a in attributes])
    why = F.filter(F.array(*[F.when(F.col(f"lo_{a}") != F.col(f"hi_{a}"), F.lit(a)) for a in attributes]), lambda x: x.isNotNull())
    return g.select(group, "n", F.array_join(why, ",").alias("conflicts"))


def cliques(nodes: DataFrame, edges: DataFrame, group: str, node: str) -> DataFrame:
    """Whether all n(n-1)/2 pairs of a group are among its edges."""
    n = nodes.select(group, node).distinct().groupBy(group).agg(F.count("*").alias("n"))
    e = edges.where(F.col("a") != F.col("b")).select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().groupBy(group).agg(F.count("*").alias("n_pairs"))
    return n.join(e, group, "left").select(group, "n", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), (F.coalesce("n_pairs", F.lit(0)) == F.col("n") * (F.col("n") - 1) / 2).alias("is_clique"))


def audit(rows: DataFrame, key: list[str], problems: dict[str, Column]) -> DataFrame:
    """One row per key and problem it shows; ``problems`` maps names to conditions."""
    each = F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in problems.items()]), lambda x: x.isNotNull()))
    return rows.select(*key, each.alias("problem")).distinct()


def brand_lexicon(rows: DataFrame, brand: str) -> DataFrame:
    """Spellings that agree without blanks share the most frequent one (ties: least text)."""
    n = rows.where(F.col(brand).isNotNull()).groupBy(F.col(brand).alias("spelling")).agg(F.count("*").alias("n"))
    k = n.withColumn("squashed", F.replace("spelling", F.lit(" "), F.lit("")))
    best = k.groupBy("squashed").agg(F.min(F.struct((-F.col("n")).alias("o"), F.col("spelling").alias("s"))).alias("b"), F.sum("n").alias("n_rows"), F.count("*").alias("n_spellings"))
    return best.select("squashed", F.col("b.s").alias("brand"), "n_rows", "n_spellings")
