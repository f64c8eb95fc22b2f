"""File sources: acceptance, security scan, quarantine, plain-text blocks, HTML tables, optional PDF pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.text import extension, sanitize_filename

# Accepted extensions with their first bytes, and what marks dangerous content.
MAGIC = {".pdf": "25504446", ".docx": "504B0304", ".doc": "D0CF11E0"}
CRITICAL = ["/JavaScript", "/JS", "/Launch", "/EmbeddedFile"]
SUSPICIOUS = ["/OpenAction", "/AA", "/RichMedia", "/XFA"]
EXECUTABLE = ["4D5A9000", "7F454C46", "CAFEBABE"]
#: Formats that are accepted but have no parser here.
UNPARSED = [".docx", ".doc"]


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content, length, modificationTime of accepted files; other extensions never leave the scan."""
    got = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return got.where(extension(F.col("path")).isin(list(MAGIC)))


def security_scan(df: DataFrame, max_mb: float = 10) -> DataFrame:
    """``security``: is_safe, risk_level, findings and a safe file name; built from binary comparisons only."""
    ext = extension(F.col("path"))
    content = F.col("content")
    has = lambda word: F.contains(content, F.lit(word.encode()))
    wrong = F.lit(False)
    for e, magic in MAGIC.items():
        wrong = F.when(ext == e, ~F.startswith(content, F.to_binary(F.lit(magic), F.lit("hex")))).otherwise(wrong)
    pdf = ext == ".pdf"
    tail = F.substring(content, 5, 2147483647)
    findings = F.array_compact(
        F.array(
            F.when(F.length(content) > max_mb * 1048576, "file_too_large"),
            F.when(F.length(content) == 0, "empty_file"),
            F.when(~ext.isin(list(MAGIC)), "extension_not_allowed"),
            F.when(wrong, "magic_mismatch"),
            *[F.when(pdf & has(w), f"pdf_keyword:{w}") for w in CRITICAL + SUSPICIOUS],
            *[F.when(F.contains(tail, F.to_binary(F.lit(x), F.lit("hex"))), "executable_content") for x in EXECUTABLE],
        )
    )
    critical = F.exists(findings, lambda f: ~f.isin([f"pdf_keyword:{w}" for w in SUSPICIOUS]))
    report = F.struct(
        (~critical).alias("is_safe"),
        F.when(critical, "critical").when(F.size(findings) > 0, "medium").otherwise("low").alias("risk_level"),
        F.array_distinct(findings).alias("findings"),
        sanitize_filename(F.col("path")).alias("sanitized_filename"),
    )
    return df.withColumns({"security": report, "content_md5": F.md5("content")})


def split_safe(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to go on with, and the quarantine: unsafe ones and formats without a parser."""
    bad = ~F.col("security.is_safe") | extension(F.col("path")).isin(UNPARSED)
    return scanned.where(~bad), scanned.where(bad).withColumn("why", F.when(~F.col("security.is_safe"), F.array_join("security.findings", ",")).otherwise("unsupported_format"))


def text_blocks(docs: DataFrame, text: str = "text", pitch: float = 18.0, blank: float = 10.0) -> DataFrame:
    """Blocks of plain texts: one for each filled line; capitals are bold headers of size 14, others 11."""
    lines = docs.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("line_no", "text"))

    before = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    step = F.when(F.trim("text") == "", blank).otherwise(pitch)
    placed = lines.withColumn("y0", 50 + F.coalesce(F.sum(step).over(before), F.lit(0.0))).where("trim(text) <> ''")
    caps = (F.col("text") == F.upper("text")) & F.col("text").rlike("[A-Z]{3}")
    return placed.select(
        "doc_id",
        F.col("line_no").alias("block_seq"),
        F.lit(1).alias("page_num"),
        F.lit(50.0).alias("x0"),
        "y0",
        F.lit(550.0).alias("x1"),
        (F.col("y0") + 14).alias("y1"),
        F.when(caps, 14.0).otherwise(11.0).alias("font_size"),
        caps.alias("is_bold"),
        caps.alias("is_header"),
        F.trim("text").alias("text"),
    )


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif self.tables and tag == "tr":
            self.tables[-1].append([])
        elif self.tables and tag in ("td", "th"):
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


@udtf(returnType="table_idx int, row_idx int, headers array<string>, cells map<string,string>")
class HtmlTables:
    """Rows of every table with a header and data: blank headers become col_i, short rows are padded."""

    def eval(self, html: str) -> Iterator[tuple]:
        parser = _Tables()
        parser.feed(html or "")
        for k, rows in enumerate(r for r in parser.tables if len(r) >= 2):
            heads = [h or f"col_{i}" for i, h in enumerate(rows[0])]
            for i, row in enumerate(rows[1:]):
                yield k, i, heads, dict(zip(heads, row + [""] * (len(heads) - len(row))))


def html_tables(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` laterally joined to the rows of its HTML tables."""
    spark = df.sparkSession
    spark.udtf.register("parchline_html_tables", HtmlTables)
    df.createOrReplaceTempView("parchline_html_input")
    return spark.sql(f"SELECT t.*, h.table_idx, h.row_idx, h.headers, h.cells FROM parchline_html_input t, LATERAL parchline_html_tables(t.`{html}`) h")


def table_text(df: DataFrame) -> DataFrame:
    """Cells of a row, in the order of the headers, as ``a | b``."""
    return df.withColumn("line", F.array_join(F.transform("headers", lambda h: F.col("cells")[h]), " | "))


def pdf_blocks(df: DataFrame, mode: str = "blocks") -> DataFrame:
    """Blocks (or words, or text) of PDF contents by an optional library; rows whose file or library fails carry ``error``."""
    schema = "path string, page_num int, block_seq int, x0 double, y0 double, x1 double, y1 double, width double, height double, font_size double, is_bold boolean, text string, error string"

    def read(batches):
        import pandas as pd

        try:
            import fitz
        except ImportError:
            fitz = None
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                if fitz is None:
                    rows.append((path, None, None, None, None, None, None, None, None, None, None, None, "no PDF library"))
                    continue
                try:
                    with fitz.open(stream=content, filetype="pdf") as doc:
                        for page in doc:
                            found = page.get_text("words" if mode == "words" else "blocks")
                            for i, b in enumerate(found):
                                rows.append((path, page.number + 1, i, *b[:4], page.rect.width, page.rect.height, 0.0, False, b[4], None))
                except Exception as error:  # noqa: BLE001
                    rows.append((path, None, None, None, None, None, None, None, None, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return df.select("path", "content").mapInPandas(read, schema)


def merged_blocks(digital: DataFrame, scanned: DataFrame) -> DataFrame:
    """Blocks of both readings of mixed files, columns of either; ``merged_rank`` orders a document's by page and height, digital ones first."""
    both = digital.withColumn("origin", F.lit("digital")).unionByName(scanned.withColumn("origin", F.lit("scanned")), allowMissingColumns=True)
    return both.withColumn("merged_rank", F.row_number().over(W.partitionBy("doc_id").orderBy("page_num", "y0", "origin", "block_seq")))


def routed_blocks(files: DataFrame, readers: dict[str, Callable[[DataFrame], DataFrame]], kind: str = "pdf_type") -> DataFrame:
    """Blocks of every file by the reader of its kind; ``readers`` must hold ``digital``.

    Mixed files go through both readers and are merged. Files of a kind without a reader (null too) go to the digital one, and
    so do files of which a scanned reader gives no block.
    """
    digital, scanned = readers["digital"], readers.get("scanned")
    own = [k for k in readers if k not in ("digital", "scanned", "mixed")]
    if scanned is None:
        plain = files.where(~F.coalesce(F.col(kind).isin(own), F.lit(False))) if own else files
        parts = [digital(plain).withColumn("origin", F.lit("digital"))]
    else:
        seen = scanned(files.where(F.col(kind) == "scanned")).withColumn("origin", F.lit("scanned"))
        rest = files.where(F.col(kind) == "scanned").join(seen.select("doc_id").distinct(), "doc_id", "left_anti")
        plain = files.where(~F.coalesce(F.col(kind).isin("scanned", "mixed", *own), F.lit(False)))
        mixed = files.where(F.col(kind) == "mixed")
        parts = [digital(plain.unionByName(rest)).withColumn("origin", F.lit("digital")), seen, merged_blocks(digital(mixed), scanned(mixed))]
    parts += [readers[k](files.where(F.col(kind) == k)).withColumn("origin", F.lit(k)) for k in own]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
