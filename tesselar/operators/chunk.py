"""Structure-aware chunking of Markdown: sections by headings, windows of paragraphs within them.

Cutting one document needs no other, so it is an Arrow map without a shuffle. Identifiers that count chunks densely are
added only on demand (`numbered`), from exact offsets per document.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselar.functions import plain
from tesselar.session import checkpointed

MAX_TOKENS, OVERLAP, MIN_TOKENS = 320, 60, 20
_HEADING = re.compile("(#{1,6})" + r"\s+" + "(.*)$")
_BLANK = re.compile(r"\n\s*\n")


def sections(text: str) -> list[tuple]:
    """(trail of headings, body, line of the heading) of every section that isn't blank; text before any heading is one."""
    out, trail, body, begin, fenced = [], [], [], 1, False
    for n, line in enumerate(text.splitlines(), 1):
        if line.lstrip()[:3] == "`" * 3:
            fenced = not fenced
        found = None if fenced else _HEADING.match(line)
        if found is None:
            body.append(line)
            continue
        out.append((" > ".join(trail), "\n".join(body).strip(), begin))
        trail = [*trail[: len(found[1]) - 1], found[2].strip()]
        body, begin = [], n
    out.append((" > ".join(trail), "\n".join(body).strip(), begin))
    return [s for s in out if s[1]]


def windows(body: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs packed into windows; a full one hands its last paragraphs on, as many as fit `overlap` tokens.

    A paragraph is never split, and one that follows what was handed on joins it whatever its length.
    """
    parts = [(p, len(plain.tokens(p))) for p in _BLANK.split(body) if p.strip()]
    done, open_, size = [], [], 0
    for part in parts:
        if open_ and size + part[1] > max_tokens:
            done.append(open_)
            keep, size = len(open_), 0
            while keep and size + open_[keep - 1][1] <= overlap:
                keep -= 1
                size += open_[keep][1]
            open_ = open_[keep:]
        open_ = [*open_, part]
        size += part[1]
    if open_:
        done.append(open_)
    return ["\n\n".join(p for p, _ in w) for w in done] or [body]


def chunk(docs: DataFrame, *, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc_id, project, title, section, window, start_line, n_tokens, text) of docs (doc_id STRING, project, title, text).

    section and window count from 0 in the document; a chunk of fewer than min_tokens tokens is left out.
    """
    names = ["doc_id", "project", "title", "section", "window", "start_line", "n_tokens", "text"]

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for s, (trail, body, line) in enumerate(sections(r["text"] or "")):
                    title = " > ".join(x for x in (r["title"] or "", trail) if x)
                    for w, piece in enumerate(windows(body, max_tokens, overlap)):
                        n = len(plain.tokens(piece))
                        if n >= min_tokens:
                            out.append((r["doc_id"], r["project"], title, s, w, line, n, piece))
            columns = list(zip(*out)) if out else [[] for _ in names]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    some = docs.select(F.col("doc_id").cast("string"), F.col("project").cast("string"), "title", "text")
    return some.mapInArrow(run, "doc_id string, project string, title string, section int, window int, start_line int, n_tokens int, text string")


def numbered(chunks: DataFrame) -> DataFrame:
    """chunks with `id`, dense from 0 in the order of (doc_id, section, window).

    Documents are cut into ranges and counted in order within each; only one number per range passes through a single
    task. Chunks are numbered within their documents.
    """
    per_doc = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    # Written down, so that the ranges are the same whenever they are read.
    placed = checkpointed(per_doc.repartitionByRange("doc_id").withColumn("range", F.spark_partition_id()))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = placed.groupBy("range").agg(F.sum("n").alias("n")).select("range", before(Window.orderBy("range")).alias("first"))
    offsets = placed.withColumn("inside", before(Window.partitionBy("range").orderBy("doc_id"))).join(F.broadcast(ranges), "range").select("doc_id", (F.col("first") + F.col("inside")).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "window")) - 1
    return chunks.withColumn("nth", nth).join(offsets, "doc_id").withColumn("id", F.col("offset") + F.col("nth")).drop("nth", "offset")
