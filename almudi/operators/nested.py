"""Deeply nested captured pages -> related flat tables (problem 1).

One pass over the payloads: a depth-first visitor emits rows of four tables in long
form (tag, primary key, parent key, payload). The stream is written once, partitioned by
tag, and every flat table is a partition-pruned read of it with its own schema. Keys are
paths (page/document/variant/entry), so each row can be traced to its parent without a
lookup and the whole conversion needs no shuffle.

Defined results
    * null, blank or incomplete JSON: the page row has ``is_complete`` false, no children.
    * ``documents`` may be a list, one object, an object keyed by pid, or lie below ``data``.
    * a lone variant, price or availability counts as a list of one; nulls keep positions.
    * a repeated key of one object: the last one counts (as JSON parsers do).
    * extra columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almudi.core.runtime import written

EMITTED = "tag string, pk string, parent_pk string, payload string"

#: Schemas applied to the payloads, by tag.
TABLES = {
    "page": "page_id long, club string, is_complete boolean, n_documents int",
    "document": "page_id long, doc_pos int, pid string, title string, brand string, master_sku string, currency string, slug string, attributes string",
    "variant": "page_id long, pid string, doc_pos int, variant_pos int, skuid string, inventory string",
    "price": "page_id long, pid string, doc_pos int, variant_pos int, skuid string, entry_pos int, price_minor long, availability string",
}

_WHOLE = re.compile(r"[+-]?\d+")
_DECIMAL = re.compile(r"([+-]?)(\d*)[.,](\d+)")


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, (bool, dict, list)):
        return json.dumps(value, ensure_ascii=False)
    return str(value)


def as_list(value) -> list:
    """A list as delivered; a lone value as a list of one; nothing as an empty list."""
    if isinstance(value, list):
        return value
    return [] if value is None else [value]


def price_minor(value) -> int | None:
    """Cents: a whole number as it is, a decimal one is lempiras (half a cent rounds up)."""
    if value is None or isinstance(value, (bool, dict, list)):
        return None
    if isinstance(value, float):
        value = str(int(value)) if value == int(value) else repr(value)
    text = str(value).strip()
    if _WHOLE.fullmatch(text):
        return int(text)
    if m := _DECIMAL.fullmatch(text):
        digits = (m[3] + "000")[:3]
        cents = int(m[2] or 0) * 100 + int(digits[:2]) + (digits[2] >= "5")
        return -cents if m[1] == "-" else cents
    return None


def availability_at(values: list, pos: int) -> str:
    word = str(values[pos]).strip().lower() if pos < len(values) else ""
    return word if word in ("true", "false") else "unknown"


def _documents(page) -> list[tuple[str | None, object]]:
    """(pid by key, document) of a page in any of its delivered shapes."""
    if isinstance(page, list):
        return [(None, d) for d in page]
    if not isinstance(page, dict):
        return []
    docs = page.get("documents")
    if docs is None and isinstance(page.get("data"), (dict, list)):
        return _documents(page["data"])
    if isinstance(docs, dict):
        if "pid" in docs or "variants" in docs or not all(isinstance(d, dict) for d in docs.values()):
            return [(None, docs)]
        return list(docs.items())
    return [(None, d) for d in as_list(docs)]


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def visit(page_id: int, club: str | None, payload: str | None) -> Iterator[tuple[str, str, str | None, dict]]:
    """Depth-first walk of one page: (tag, key, parent key, fields)."""
    root = str(page_id)
    try:
        page = json.loads(payload or "", parse_constant=_no_constant)
    except (ValueError, RecursionError):
        yield "page", root, None, {"page_id": page_id, "club": club, "is_complete": False, "n_documents": 0}
        return
    docs = _documents(page)
    yield "page", root, None, {"page_id": page_id, "club": club, "is_complete": True, "n_documents": len(docs)}
    for d, (by_key, doc) in enumerate(docs):
        if not isinstance(doc, dict):
            continue
        pid = _text(doc.get("pid"))
        pid = by_key if pid is None else pid
        doc_key = f"{root}/{d}"
        rest = {k: v for k, v in doc.items() if k not in ("variants", "pid", "title", "brand", "master_sku", "currency", "slug")}
        yield "document", doc_key, root, {"page_id": page_id, "doc_pos": d, "pid": pid, "attributes": json.dumps(rest, ensure_ascii=False)} | {k: _text(doc.get(k)) for k in ("title", "brand", "master_sku", "currency", "slug")}
        for v, variant in enumerate(as_list(doc.get("variants"))):
            if not isinstance(variant, dict):
                continue
            sku = _text(variant.get("skuid")) or ""
            at = {"page_id": page_id, "pid": pid, "doc_pos": d, "variant_pos": v, "skuid": sku}
            variant_key = f"{doc_key}/{v}"
            stock = as_list(variant.get("inventory_HN_6602"))
            yield "variant", variant_key, doc_key, at | {"inventory": _text(stock[0]) if stock else None}
            prices = [(e, p) for e, x in enumerate(as_list(variant.get("price_HN_6602"))) if (p := price_minor(x)) is not None]
            flags = as_list(variant.get("availability_HN_6602"))
            for e, p in prices or [(0, -1)]:
                yield "price", f"{variant_key}/{e}", variant_key, at | {"entry_pos": e, "price_minor": p, "availability": availability_at(flags, e)}


SLICE = 4096


def emit(pages: DataFrame) -> DataFrame:
    """Tagged rows of all four tables in one pass over (page_id, club, payload). Rows leave in
    slices, so a batch of large pages is never held as a whole."""

    def run(batches):
        rows = ((tag, pk, parent, json.dumps(x, ensure_ascii=False)) for pdf in batches for i, c, p in zip(pdf.page_id, pdf.club, pdf.payload, strict=True) for tag, pk, parent, x in visit(int(i), c, p))
        while part := list(islice(rows, SLICE)):
            yield pd.DataFrame(part, columns=["tag", "pk", "parent_pk", "payload"])

    return pages.select("page_id", "club", "payload").mapInPandas(run, EMITTED)


class FlatTables:
    """The emitted stream, written by tag; ``table(tag)`` reads one flat table."""

    def __init__(self, pages: DataFrame):
        self.spark = pages.sparkSession
        self.path = written(emit(pages), "nested", ("tag",))

    def table(self, tag: str) -> DataFrame:
        rows = self.spark.read.schema(EMITTED).parquet(self.path).where(F.col("tag") == tag)
        return rows.select("pk", "parent_pk", F.from_json("payload", TABLES[tag]).alias("x")).select("pk", "parent_pk", "x.*")
