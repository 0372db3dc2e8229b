"""Files as tables: documents, JSON, text, listings. Whole files are read by Spark's binaryFile, never by the driver."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import read_text, strip
from ..session import written
from . import pdf
from .office import read_xlsx

#: (position, kind 'text' or 'table', text, rows of a table)
Block = tuple[int, str, str, list[list[str]]]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, json) of whole files, in UTF-8 or else Windows-1252; what isn't JSON has a null ``json``."""
    files = spark.read.format("binaryFile").load(path).select("path", read_text(F.col("content")).alias("t"))
    return files.select("path", F.when(F.call_function("is_variant_null", F.try_parse_json("t")).isNotNull(), F.col("t")).alias("json"))


def read_json_strict(spark: SparkSession, path: str) -> DataFrame:
    """(path, json), UTF-8 only; an error for a file that isn't JSON."""
    files = spark.read.format("binaryFile").load(path).select("path", F.validate_utf8(F.col("content").cast("string")).alias("json"))
    return files.select("path", F.when(F.parse_json("json").isNotNull(), F.col("json")).alias("json"))


_SNIPPET = "locator:string,text:string,type:string"


def read_index_json(spark: SparkSession, path: str) -> DataFrame:
    """An index from its JSON form, UTF-8 or else Windows-1252: a row per snippet, in order (``pos``), with its vector."""
    kind = f"struct<model:string,snippets:array<struct<source_id:string,source_title:string,{_SNIPPET},embedding:array<double>>>>"
    rows = read_json_documents(spark, path).select(F.from_json("json", kind).alias("i"))
    return rows.select(F.col("i.model").alias("model"), F.posexplode("i.snippets").alias("pos", "s")).select("pos", "s.*", "model")


def read_sources_json(spark: SparkSession, path: str) -> DataFrame:
    """Sources from their JSON form: a row each, in order (``pos``), with its snippets as an array."""
    kind = f"struct<sources:array<struct<source_id:string,source_title:string,source_type:string,reference:string,snippets:array<struct<{_SNIPPET}>>>>>"
    rows = read_json_documents(spark, path).select(F.from_json("json", kind).alias("d"))
    return rows.select(F.posexplode("d.sources").alias("pos", "s")).select("pos", "s.*")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(template): one row per whole file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "template")


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A table from Parquet, CSV or a spreadsheet (the named or first sheet, all columns as strings)."""
    if path.endswith(".xlsx"):
        content = spark.read.format("binaryFile").load(path).first()["content"]  # spreadsheets are small by nature
        head, *rows = read_xlsx(bytes(content), sheet)
        names = [h or f"_{i}" for i, h in enumerate(head)]
        rows = [(*r, *[None] * (len(names) - len(r)))[: len(names)] for r in rows]
        return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True)
    return spark.read.parquet(path)


def docx_blocks(content: bytes) -> list[Block]:
    """Paragraphs and tables of a word-processor file in order, from its XML."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out: list[Block] = []
    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            out.append((len(out), "text", text(e), []))
        elif e.tag == f"{_W}tbl":
            rows = [["\n".join(text(p) for p in cell.iter(f"{_W}p")) for cell in row.iter(f"{_W}tc")] for row in e.iter(f"{_W}tr")]
            out.append((len(out), "table", "", rows))
    return out


def html_blocks(content: bytes) -> list[Block]:
    """Text blocks and tables of a web page, in order."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.out, self.cur, self.rows, self.row, self.skip = [], [], None, None, 0

        def flush(self) -> None:
            t = re.sub(r"\s+", " ", "".join(self.cur)).strip()
            self.cur = []
            if t and self.rows is None:
                self.out.append((len(self.out), "text", t, []))
            return t

        def handle_starttag(self, tag, attrs) -> None:
            if tag in ("script", "style"):
                self.skip += 1
            elif tag == "table":
                self.flush()
                self.rows = []
            elif tag == "tr" and self.rows is not None:
                self.row = []
            elif tag in ("p", "li", "h1", "h2", "h3", "h4", "div", "br", "td", "th"):
                self.flush()

        def handle_endtag(self, tag) -> None:
            if tag in ("script", "style"):
                self.skip = max(0, self.skip - 1)
            elif tag in ("td", "th") and self.row is not None:
                t = re.sub(r"\s+", " ", "".join(self.cur)).strip()
                self.cur = []
                self.row.append(t)
            elif tag == "tr" and self.rows is not None and self.row is not None:
                self.rows.append(self.row)
                self.row = None
            elif tag == "table" and self.rows is not None:
                rows, self.rows, self.cur = self.rows, None, []
                self.out.append((len(self.out), "table", "", rows))
            elif tag in ("p", "li", "h1", "h2", "h3", "h4", "div"):
                self.flush()

        def handle_data(self, data) -> None:
            if not self.skip:
                self.cur.append(data)

    r = Reader()
    r.feed(content.decode("utf-8", "replace"))
    r.flush()
    return r.out


READERS: dict[str, Callable[[bytes], list[Block]]] = {"docx": docx_blocks, "html": html_blocks}
_BLOCKS = "path string, kind string, pos int, page int, type string, text string, rows array<array<string>>, error string"


#: Bytes of a PDF file's pages that a task hands on together, and the page that goes beyond.
PAGES = 4 << 20


def read_blocks(files: DataFrame, readers: dict[str, Callable[[bytes], list[Block]]] | None = None) -> DataFrame:
    """(path, kind, pos, page, type, text, rows, error): the blocks of files (path, content), parsed on the executors.

    ``readers`` maps a file's ending to a parser; own ones can be given. Without one for them, PDF files become a row
    per page, written once, of which ``pdf.page_blocks`` makes lines and tables. A file that can't be parsed is one
    row with its ``error`` (pages read before stay), so the source stays.
    """
    known = readers or READERS
    own = "pdf" not in known
    columns = [c.split()[0] for c in _BLOCKS.split(", ")] + ["body", "known"]

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                kind, out = path.rsplit(".", 1)[-1].lower(), []
                try:
                    if kind == "pdf" and own:
                        out, size = [], 0
                        for n, body, names in pdf.read_pages(bytes(content)):
                            out.append((path, kind, None, n, None, None, None, None, body, names))
                            size += len(body) + len(names)
                            if size > PAGES:
                                yield pd.DataFrame(out, columns=columns)
                                out, size = [], 0
                        yield pd.DataFrame(out, columns=columns)
                        continue
                    blocks = known[kind](bytes(content))
                    out = [(path, kind, i, pos, t, text, rows, None, None, None) for i, (pos, t, text, rows) in enumerate(blocks)]
                except Exception as e:
                    out = [*out, (path, kind, *[None] * 5, f"{type(e).__name__}: {e}", None, None)]
                yield pd.DataFrame(out, columns=columns)

    opened = files.select("path", "content").mapInPandas(parsed, f"{_BLOCKS}, body binary, known string")
    if not own:
        return opened.drop("body", "known")
    opened = written(opened)
    return opened.where("body IS NULL").drop("body", "known").unionByName(pdf.page_blocks(opened.where("body IS NOT NULL")))


def scan_directory(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("pdf", "docx")) -> DataFrame:
    """Files of a folder's ``{kind}`` subfolders with ids SRC1, SRC2, …: kinds in order, names in order. An error if there are none."""
    from ..operators.chunking import number_sources

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(kinds) + "}").load(path)
    files = files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).withColumn("kind", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)))
    listed = files.drop("content")
    if not listed.take(1):
        raise FileNotFoundError(f"no {' or '.join(kinds)} file under {path}")
    rank = F.array_position(F.array(*(F.lit(k) for k in kinds)), F.col("kind"))
    return number_sources(listed, rank).join(files.select("path", "content"), "path")


def latest_outputs(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """(job_id, path): the newest ``output_{mode}.json`` under each job's run folders; empty if there is none."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"output_{mode}.json").load(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "job_id string, path string")
    job = F.regexp_extract("path", r"/([^/]+)/[^/]+/output_[^/]*$", 1)
    return files.groupBy(job.alias("job_id")).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def is_country_folder(name: Column) -> Column:
    """Three letters, in either case."""
    return F.rlike(name, F.lit(r"^(?i)[a-z]{3}$"))


def snippets_of(blocks: DataFrame) -> DataFrame:
    """Blocks of paged and of flowing documents as snippets (path, pos, locator, text, type); blank ones are dropped."""
    from ..functions.text import markdown_table
    from ..operators.chunking import number_tables, section_islands

    good = blocks.where("error IS NULL")
    paged = good.where("kind = 'pdf'")
    tables = number_tables(paged.where("type = 'table'"), "path", "page", "pos").withColumn("text", markdown_table(F.col("rows")))
    pages = paged.where("type = 'text'").withColumn("locator", F.concat(F.lit("p. "), F.col("page").cast("string")))
    shown = ("path", "pos", "locator", "text", "type")
    flow = good.where("kind <> 'pdf'").withColumn("is_table", F.col("type") == "table").withColumn("text", F.when(F.col("is_table"), markdown_table(F.col("rows"))).otherwise(F.col("text")))
    sections = section_islands(flow, "path", "pos", "is_table", "text").withColumn("type", F.when(F.col("is_table"), "table").otherwise("text")).withColumnRenamed("first_pos", "pos")
    every = tables.select(*shown).unionByName(pages.select(*shown)).unionByName(sections.select(*shown))
    return every.withColumn("text", strip(F.col("text"))).where("text <> ''")
