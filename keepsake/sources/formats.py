"""Files of several formats as one table of documents: path, format, text, sections.

Files are read by Spark's own readers, whole, so a path may be in any store that Spark reaches. Large line-oriented data
belongs to ``spark.read``; these readers are for documents, which fit in a row."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lines import PARTS, joined_lines, markdown_sections, pdf_sections, text_sections, without_back_matter
from ..functions.text import clean_document, clean_text, dehyphenated, plain_characters, strip_html, tidy_white_space, without_noise, without_repeated_lines
from . import pdf

FORMATS = {"txt": "text", "text": "text", "log": "text", "md": "markdown", "markdown": "markdown", "json": "json", "csv": "csv", "tsv": "csv", "yaml": "yaml", "yml": "yaml", "html": "html", "htm": "html", "docx": "docx", "pdf": "pdf"} | {x: "code" for x in ("py", "ts", "tsx", "js", "jsx", "java", "go", "rs", "cpp", "c", "h", "rb", "php", "swift", "kt", "scala", "sh", "bash", "sql")}


def format_of(path: Column) -> Column:
    """By the extension, else unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.create_map(*(F.lit(x) for p in FORMATS.items() for x in p))[ext], F.lit("unknown"))


def decoded(content: Column) -> Column:
    """Bytes as text by their byte order mark, UTF-8 without one."""
    head = F.hex(F.substring(content, 1, 3))
    rest = lambda n: F.substring(content, F.lit(n + 1), F.length(content))
    lossy = cut_bytes(rest(0))
    return F.when(head == "EFBBBF", F.decode(rest(3), "UTF-8")).when(head.startswith("FFFE"), F.decode(rest(2), "UTF-16LE")).when(head.startswith("FEFF"), F.decode(rest(2), "UTF-16BE")).when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(lossy)


def cut_bytes(content: Column) -> Column:
    """Bytes that are no valid UTF-8 become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def document_text(content: bytes) -> str:
    """Paragraphs of a DOCX file; empty if it is none."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            root = ElementTree.fromstring(archive.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def json_sections(text: str, depth: int = 3) -> list[dict]:
    """Keys to ``depth`` levels as sections; arrays give their size and first values. Trailing commas are forgiven."""
    for source in (text, re.sub(r",\s*([}\]])", r"\1", text)):
        try:
            value = json.loads(source)
            break
        except ValueError:
            continue
    else:
        return [{"heading": None, "level": 0, "text": text}]
    out: list[dict] = []

    def walk(node: object, path: str, level: int) -> None:
        if isinstance(node, dict) and level < depth:
            for k, v in node.items():
                walk(v, f"{path}.{k}" if path else str(k), level + 1)
        elif isinstance(node, list):
            out.append({"heading": path or None, "level": level, "text": f"{len(node)} items: " + json.dumps(node[:5], ensure_ascii=False)})
        else:
            out.append({"heading": path or None, "level": level, "text": node if isinstance(node, str) else json.dumps(node, ensure_ascii=False)})

    walk(value, "", 0)
    return out


def csv_rows(text: str) -> list[list[str]]:
    import csv

    first = text.split("\n", 1)[0]
    sep = "\t" if "\t" in first else ";" if first.count(";") > first.count(",") else ","
    return [r for r in csv.reader(io.StringIO(text), delimiter=sep) if r]


def csv_sections(text: str, sample: int = 5) -> list[dict]:
    """One section: columns, number of rows, the first rows."""
    rows = csv_rows(text)
    if not rows:
        return []
    head, body = rows[0], rows[1:]
    lines = [f"Columns: {', '.join(head)}", f"Rows: {len(body)}"] + [", ".join(f"{k}={v}" for k, v in zip(head, r, strict=False)) for r in body[:sample]]
    return [{"heading": "table", "level": 1, "text": "\n".join(lines)}]


def yaml_sections(text: str) -> list[dict]:
    """A section for each key at the left margin, with the lines below it."""
    out: list[dict] = []
    for line in text.split("\n"):
        if m := re.match(r"([A-Za-z0-9_.-]+):(?:\s+(.*))?$", line):
            out.append({"heading": m[1], "level": 1, "text": m[2] or ""})
        elif out and line.strip():
            out[-1]["text"] = f"{out[-1]['text']}\n{line}".strip("\n")
    return out or [{"heading": None, "level": 0, "text": text}]


DECLARATION = re.compile(r"(\s*)(?:export\s+|public\s+|private\s+|protected\s+|static\s+|async\s+|pub\s+)*(class|interface|struct|enum|trait|impl|def|function|func|fn|object)\s+\(?([A-Za-z_][A-Za-z0-9_]*)")


def code_sections(text: str) -> list[dict]:
    """A section for each declared class or function: from its line to the next line that isn't indented deeper and isn't blank or closing."""
    lines, out = text.split("\n"), []
    for i, line in enumerate(lines):
        if not (m := DECLARATION.match(line)):
            continue
        indent, end = len(m[1]), i + 1
        while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > indent or lines[end].strip()[0] in "}])"):
            end += 1
        out.append({"heading": m[3], "level": 1 + indent // 4, "text": "\n".join(lines[i:end]).rstrip()})
    return out or [{"heading": None, "level": 0, "text": text}]


def html_sections(html: str) -> list[dict]:
    """By h1 to h6; the text between two belongs to the first."""
    parts = re.split(r"(?is)<h([1-6])[^>]*>(.*?)</h\1>", html)
    out = [{"heading": None, "level": 0, "text": parts[0]}] if re.sub(r"<[^>]+>", "", parts[0]).strip() else []
    for level, heading, body in zip(parts[1::3], parts[2::3], parts[3::3], strict=True):
        out.append({"heading": re.sub(r"<[^>]+>", "", heading).strip(), "level": int(level), "text": body})
    return [s | {"text": re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", s["text"])).strip()} for s in out]


#: Formats whose sections are cut outside the JVM.
CUTTERS = {"json": json_sections, "csv": csv_sections, "yaml": yaml_sections, "code": code_sections, "html": html_sections}


def pdf_documents(files: DataFrame, shortest: int = 10) -> DataFrame:
    """path, format, text and error of PDF files: their text layers without noise, broken lines and back matter. A file of fewer characters has no text and says so."""
    told = dehyphenated(without_noise(without_repeated_lines(plain_characters(F.col("text")))))
    clean = without_back_matter(tidy_white_space(joined_lines(told)))
    rows = pdf.texts(files).select("path", F.lit("pdf").alias("format"), clean.alias("text"), "error")
    return rows.withColumn("error", F.coalesce("error", F.when(F.length("text") < shortest, F.lit("the file contains no extractable text"))))


def read_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, format, text, error of every file below a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content").withColumn("format", format_of(F.col("path")))

    @F.pandas_udf(T.StringType())
    def from_docx(content: pd.Series) -> pd.Series:
        return content.map(document_text)

    plain = files.filter("format not in ('pdf', 'docx')").select("path", "format", tidy_white_space(decoded(F.col("content"))).alias("text"), F.lit(None).cast("string").alias("error"))
    docx = files.filter("format = 'docx'").select("path", "format", clean_text(from_docx("content")).alias("text"), F.lit(None).cast("string").alias("error"))
    of_pdf = pdf_documents(files.filter("format = 'pdf'").select("path", "content"))
    return plain.unionByName(docx).unionByName(of_pdf)


def parsed(documents: DataFrame) -> DataFrame:
    """Adds sections by the format's rules; text of HTML and Markdown without its markup. Only texts of ``CUTTERS`` leave the JVM."""
    kind, text = F.col("format"), F.col("text")
    outside = kind.isin(*CUTTERS)

    @F.pandas_udf(PARTS)
    def cut_by_format(kinds: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([CUTTERS[k](t or "") if k in CUTTERS else None for k, t in zip(kinds, texts, strict=True)])

    cut = cut_by_format(F.when(outside, kind), F.when(outside, text))
    sections = F.when(kind == "markdown", markdown_sections(text)).when(kind == "pdf", pdf_sections(text)).when(~outside, text_sections(text)).otherwise(cut)
    bare = F.when(kind == "html", strip_html(text)).when(kind == "markdown", clean_document(text, True)).otherwise(text)
    return documents.withColumn("sections", sections).withColumn("text", bare)


def front_matter(text: Column) -> Column:
    """Keys and values of the block between --- lines at the beginning of a Markdown text."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":")))
    return F.map_from_entries(F.array_distinct(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))))


def code_blocks(text: Column) -> Column:
    """Language and body of each fenced block."""
    found = lambda group: F.regexp_extract_all(text, F.lit(r"(?s)```([A-Za-z0-9_+-]*)\n(.*?)```"), F.lit(group))
    return F.zip_with(found(1), found(2), lambda a, b: F.struct(a.alias("language"), b.alias("body")))
