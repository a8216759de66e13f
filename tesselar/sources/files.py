"""Text files as documents."""

from __future__ import annotations

import os
import re
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("md", "markdown", "mdx", "txt")
SKIP_DIRS = ("__pycache__", "build", "dist", "node_modules", "site-packages", "venv", "Library")


def read(spark: SparkSession, roots: list[str], *, exclude: tuple[str, ...] = (), extensions: tuple[str, ...] = EXTENSIONS, max_files: int | None = None) -> DataFrame:
    """(doc_id, project, title, text) of the text files under roots (folders or single files).

    Hidden folders and SKIP_DIRS aren't entered; exclude holds parts of paths, whatever their case. Bytes that aren't
    UTF-8 become replacement characters; blank files are left out. max_files takes the first by path.
    """
    found = None
    for root in roots:
        real = os.path.realpath(os.path.expanduser(unquote(urlparse(root).path) if "://" in root else root))
        single = os.path.isfile(real)
        base = os.path.dirname(real) if single else real
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(real).select("path", "content")
        path = F.url_decode(F.regexp_replace(F.regexp_replace("path", r"\+", "%2B"), r"^file:/*", "/")) if base.startswith("/") else F.col("path")
        rel = F.substring(path, F.lit(len(base.rstrip("/")) + 2), F.length(path))
        rows = files.select(path.alias("path"), rel.alias("rel"), "content")
        if not single:
            skip = "|".join(map(re.escape, SKIP_DIRS))
            rows = rows.where(F.col("rel").rlike(r"(?i)\.(" + "|".join(map(re.escape, extensions)) + ")$") & ~F.col("rel").rlike(rf"(^|/)(\.[^/]*|{skip})/"))
        name = F.lit(os.path.basename(base))
        rows = rows.withColumn("doc_id", F.regexp_extract("rel", r"[^/]+$", 0) if single else F.concat(name, F.lit("/"), F.col("rel")))
        found = rows if found is None else found.unionByName(rows)
    for part in exclude:
        found = found.where(~F.contains(F.lower("path"), F.lit(part.lower())))
    texts = found.withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").drop("content")
    if max_files is not None:
        texts = texts.orderBy("path").limit(max_files)
    stem = F.regexp_replace(F.regexp_extract("rel", r"[^/]+$", 0), r"(?<=.)\.[^.]*$", "")
    return texts.select("doc_id", F.substring_index("doc_id", "/", 1).alias("project"), F.translate(stem, "-_", "  ").alias("title"), "text")
