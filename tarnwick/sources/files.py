"""File sources and sinks: JSON documents and lines, ledgers, archives, carriers and reports."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from tarnwick.functions.fingerprint import digest

#: Bytes of a source, bytes it may expand to, and entries of an archive, at most (fixed values).
MOST_SOURCE, MOST_EXPANDED, MOST_ENTRIES = 256 << 20, 512 << 20, 8192


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON document of a known schema; a bad one raises."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_ndjson(spark: SparkSession, path: str, schema: StructType | str, missing_ok: bool = False) -> DataFrame:
    """Lines of JSON objects; blank lines are skipped, a bad one raises; a missing path can be empty."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException:
        if missing_ok:
            return spark.createDataFrame([], schema)
        raise


def read_manifests(spark: SparkSession, pattern: str, schema: StructType | str, order: Sequence[str]) -> DataFrame:
    """All manifests that a pattern names, with their file, in order."""
    rows = read_json(spark, pattern, schema).withColumn("file", F.input_file_name())
    if rows.isEmpty():
        raise ValueError(f"no manifest at {pattern}")
    return rows.orderBy(*order)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(digest, path) of a checksum ledger: lines of digest, two spaces, path."""
    parts = F.split("value", "  ", 2)
    return spark.read.text(path).where("value RLIKE '\\\\S'").select(parts[0].alias("digest"), parts[1].alias("path"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, without their content."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def carriers(parts: DataFrame, length: str = "length", sha256: str = "sha256") -> DataFrame:
    """Content of base64 carriers: parts (carrier, ord, chunk) joined in order; null if length or digest differ."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk"))), lambda p: F.regexp_replace(p["chunk"], r"\s", "")), "")
    out = parts.groupBy("carrier").agg(F.try_to_binary(whole, F.lit("base64")).alias("raw"), F.max(length).alias("length"), F.max(sha256).alias("sha256"))
    ok = (F.octet_length("raw") == F.col("length")) & (F.sha2("raw", 256) == F.col("sha256"))
    return out.select("carrier", F.when(ok, F.col("raw")).alias("content"), F.coalesce(ok, F.lit(False)).alias("passed"))


def rows_as_maps(doc: DataFrame, schema: str = "rowSchema", rows: str = "rows") -> DataFrame:
    """Arrays of arrays and the names of their columns, as one map a row."""
    return doc.select(F.posexplode(rows).alias("index", "_r"), schema).select("index", F.map_from_arrays(schema, "_r").alias("row"))


# Archives.


def safe_name(name: str) -> bool:
    """Whether an archive's entry stays inside its folder."""
    return bool(name) and "\\" not in name and not name.startswith("/") and ":" not in name and not {"", ".", ".."} & set(name.rstrip("/").split("/"))


def _text(element: ElementTree.Element | None) -> str | None:
    return "".join(element.itertext()).strip() or None if element is not None else None


def epub_units(data: bytes) -> list[dict]:
    """The reading order of an EPUB: order, label, part and markup of each unit; ValueError if it is none."""
    if len(data) > MOST_SOURCE:
        raise ValueError("the source is too large")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
        if len(infos) > MOST_ENTRIES or sum(i.file_size for i in infos) > MOST_EXPANDED:
            raise ValueError("the archive expands too far")
        for i in infos:
            if not safe_name(i.filename) or i.flag_bits & 1 or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ValueError(f"entry {i.filename!r} is refused")
        names = set(z.namelist())

        def parse(name: str) -> ElementTree.Element:
            raw = z.read(name)
            if re.search(rb"<!(?:DOCTYPE[^>]*\[|ENTITY)", raw):
                raise ValueError("entity declarations are refused")
            return ElementTree.fromstring(raw)

        box = "{urn:oasis:names:tc:opendocument:xmlns:container}"
        root = parse("META-INF/container.xml").find(f".//{box}rootfile")
        if root is None or root.get("full-path") not in names:
            raise ValueError("no package document")
        at = root.get("full-path")
        package, base = parse(at), posixpath.dirname(at)
        local = lambda e: e.tag.rpartition("}")[2]
        items = {e.get("id"): e for e in package.iter() if local(e) == "item"}
        place = lambda href: posixpath.normpath(posixpath.join(base, href.partition("#")[0]))
        labels: dict[str, str] = {}
        for e in items.values():
            if "nav" in (e.get("properties") or "").split() and place(e.get("href")) in names:
                nav = place(e.get("href"))
                for a in re.finditer(rb"(?is)<a\b[^>]*href\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a\s*>", z.read(nav)):
                    to = posixpath.normpath(posixpath.join(posixpath.dirname(nav), a[1].decode().partition("#")[0]))
                    labels.setdefault(to, re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", a[2].decode("utf-8", "replace"))).strip())
        units = []
        for ref in (e for e in package.iter() if local(e) == "itemref"):
            item = items.get(ref.get("idref"))
            if item is None or place(item.get("href")) not in names:
                continue
            part = place(item.get("href"))
            markup = z.read(part).decode("utf-8", "replace")
            head = re.search(r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]\s*>", markup)
            title = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", head[1])).strip() if head else ""
            units.append({"unit_order": len(units), "label": labels.get(part) or title or ref.get("idref"), "part": part, "markup": markup})
        if not units:
            raise ValueError("no unit in reading order")
        return units


def read_editions(files: DataFrame) -> DataFrame:
    """Units (path, format, unit_order, label, part, markup, error) of files (path, content): EPUB, HTML or plain text by their first bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "format", "unit_order", "label", "part", "markup", "error"]
        for batch in batches:
            rows: list[tuple] = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                data = bytes(data or b"")
                if data[:4] == b"PK\x03\x04":
                    try:
                        rows += [(path, "epub", u["unit_order"], u["label"], u["part"], u["markup"], None) for u in epub_units(data)]
                    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                        rows.append((path, "epub", None, None, None, None, str(e)))
                elif re.search(rb"(?i)<(?:!doctype html|html|head|body|p|h[1-6])\b", data[:4096]):
                    rows.append((path, "html", 0, None, "html", data.decode("utf-8", "replace"), None))
                else:
                    rows.append((path, "plain-text", 0, "Document", "text", data.decode("utf-8", "replace"), None))
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, "path string, format string, unit_order int, label string, part string, markup string, error string")


# Sinks.


def append_rows(new: DataFrame, path: str, key: str) -> DataFrame:
    """Append rows whose content id the ledger has not; returns what was appended."""
    from tarnwick.operators.ledger import append_new
    from tarnwick.session import materialise

    old = read_ndjson(new.sparkSession, path, new.schema, missing_ok=True)
    rows = materialise(append_new(old, new, key), "append")
    rows.write.mode("append").json(path)
    return rows


def replace_rows(rows: DataFrame, path: str) -> None:
    """Replace a ledger; the committer makes the files appear together."""
    rows.write.mode("overwrite").json(path)


def content_addressed(rows: DataFrame, body: str) -> DataFrame:
    """rows with their digest, one for each body: the content is its own name."""
    return rows.withColumn("digest", digest(F.col(body))).dropDuplicates(["digest"])


def credits(rows: DataFrame) -> DataFrame:
    """(format, line) of credits (title, author, license, source_uri): Markdown, BibTeX and JSON."""
    from tarnwick.functions.text import bib_key

    md = F.format_string("- **%s** — %s. %s. <%s>", "title", F.coalesce("author", F.lit("unknown")), F.coalesce("license", F.lit("unknown")), "source_uri")
    bib = F.format_string("@misc{%s,\n  title = {%s},\n  author = {%s},\n  url = {%s}\n}", bib_key(F.col("source_uri")), "title", F.coalesce("author", F.lit("unknown")), "source_uri")
    js = F.to_json(F.struct("author", "license", "source_uri", "title"))
    lines = F.array(*(F.struct(F.lit(n).alias("format"), c.alias("line")) for n, c in (("markdown", md), ("bibtex", bib), ("json", js))))
    return rows.select(F.explode(lines).alias("x")).select("x.*")


def html_atlas(rows: DataFrame, title: str, most: int = 10_000) -> str:
    """A page with its rows embedded as JSON; refuses more than `most`, as all go through the driver."""
    data = rows.limit(most + 1).toJSON().collect()
    if len(data) > most:
        raise ValueError(f"more than {most} rows for one page")
    body = ("[" + ",".join(data) + "]").replace("</", "<\\/")
    safe = title.replace("&", "&amp;").replace("<", "&lt;")
    return f'<!doctype html><meta charset="utf-8"><title>{safe}</title><script type="application/json" id="rows">{body}</script>'


def receipt(rows: DataFrame, *parts: str) -> DataFrame:
    """One row: how many rows, and a digest over all that does not depend on their order."""
    each = F.sha2(F.to_json(F.struct(*(parts or rows.columns))), 256)
    # digests are summed as numbers, so that no list of them is needed
    low = F.sum(F.conv(F.substring(each, 1, 12), 16, 10).cast("decimal(38,0)"))
    return rows.agg(F.count("*").alias("rows"), digest(F.coalesce(low, F.lit(0)).cast("string")).alias("fingerprint"))
