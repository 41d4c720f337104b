"""A text as an array of lines: headings, what stands between them, broken lines, back matter, titles.

A line's neighbours are found by position in the array, so nothing is shuffled, and no text leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, let, lines_of, trimmed, words_of

PART = "struct<heading:string,level:int,text:string>"
PARTS = f"array<{PART}>"

#: Lines that are headings of plain text (numbered, in capitals), of Markdown, and of papers.
NUMBERED = r"(?s)^([0-9]+(?:\.[0-9]+)*)[ \t\n\r\f\x0B]+([A-Z].{2,80})$"
CAPITALS = r"^[A-Z][A-Z \t\n\r\f\x0B]{3,50}$"
MARKED = r"(?s)^(#{1,6})[ \t\n\r\f\x0B]+(.+)$"
PDF_NUMBERED = r"(?s)^([0-9]+(?:\.[0-9]+)*)[ \t\n\r\f\x0B]+([A-Z][a-zA-Z \t\n\r\f\x0B&,;:\-]{2,80})$"
MARKED_AT_ALL = r"^#{1,6}[ \t\n\r\f\x0B]+"
NUMBERED_AT_ALL = r"^[0-9]+(?:\.[0-9]+)*\.?[ \t\n\r\f\x0B]+[A-Z]"
NAMED = r"(?i)^(?:abstract|introduction|method|methods|methodology|results?|discussion|conclusion|related work|references|background|experiments?|evaluation|appendix|preliminaries|setup)(?:[^A-Za-z0-9_]|$)"
#: Lines with which back matter begins; the last kind counts in the last three tenths only.
BACK_MATTER = (
    r"(?i)^(?:references|bibliography|works cited|literature cited)$",
    r"(?i)^(?:subject index|author index|name index|general index)$",
    r"(?i)^(?:about the (?:author|editor|publisher))$",
)
LATE_BACK_MATTER = r"(?i)^index$"
PAGE_MARK = r"^\[Page[ \t\n\r\f\x0B]+[0-9]+\]$"
#: A line that begins so is not joined to the one before it.
APART = (
    r"^[0-9]+[.)][ \t\n\r\f\x0B]",
    r"^[A-Z][A-Z \t\n\r\f\x0B]{4,}$",
    r"^#{1,6}[ \t\n\r\f\x0B]",
    r"(?i)^(?:chapter|section|figure|table|abstract|introduction|method|result|discussion|conclusion|references|appendix|acknowledgment)(?:[^A-Za-z0-9_]|$)",
    r"^[•*-][ \t\n\r\f\x0B]",
    r"^\([a-z]\)[ \t\n\r\f\x0B]",
    r"(?i)^(?:chapter|section|part|unit)[ \t\n\r\f\x0B]+[0-9]+$",
)
ENDS = r"[.!?;:\])}\"']$"


def any_of(line: Column, patterns) -> Column:
    return reduce(Column.__or__, (line.rlike(p) for p in patterns))


def paragraphs(text: Column) -> Column:
    """Trimmed, without blank ones."""
    return F.filter(F.transform(F.split(text, rf"\n{SPACE}*\n", -1), trimmed), lambda p: p != "")


def heads(bare: Column, of) -> Column:
    """at (line number from 0), heading and level of the lines for which ``of(line, number)`` gives a (heading, level) that isn't null."""
    marked = F.transform(bare, lambda line, i: F.struct(i.alias("at"), *(c.alias(n) for c, n in zip(of(line, i), ("heading", "level"), strict=True))))
    return F.filter(marked, lambda h: h["heading"].isNotNull())


def following(lines: Column, found: Column) -> Column:
    """heading, level and text of each head: the lines up to the next one."""
    until = lambda k: F.coalesce(F.get(found, k + 1)["at"], F.size(lines))
    text = lambda h, k: trimmed(F.array_join(F.slice(lines, h["at"] + 2, until(k) - h["at"] - 1), "\n"))
    return F.transform(found, lambda h, k: F.struct(h["heading"], h["level"].cast("int").alias("level"), text(h, k).alias("text")).cast(PART))


def unheaded(texts: Column) -> Column:
    return F.transform(texts, lambda p: F.struct(F.lit(None).cast("string").alias("heading"), F.lit(0).alias("level"), p.alias("text")).cast(PART))


def plain_heading(bare: Column, line: Column, i: Column) -> tuple[Column, Column]:
    """Numbered, in capitals, or a short line after a blank one and before a longer one."""
    before, after = F.get(bare, i - 1), F.get(bare, i + 1)
    standing = F.length(line).between(6, 59) & line.rlike("^[A-Z]") & ~line.rlike("[.;,]$") & (before == "") & (F.length(after) > F.length(line)) & (F.size(words_of(line)) <= 8)
    numbered, capitals = line.rlike(NUMBERED), line.rlike(CAPITALS) & (F.length(line) < 60)
    number = F.regexp_extract(line, NUMBERED, 1)
    heading = F.when(numbered, F.regexp_extract(line, NUMBERED, 2)).when(capitals | standing, line)
    return heading, F.when(numbered, F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).when(capitals, 1).otherwise(2)


def text_sections(text: Column) -> Column:
    """heading, level and text of plain text by its headings, long openings first; without any, a part for each paragraph."""

    def told(part: Column) -> Column:
        words = words_of(part["heading"])
        return (F.length(part["heading"]) >= 3) & ~part["heading"].rlike("^[0-9]+$") & ~((F.size(words) > 1) & F.forall(words, lambda w: F.length(w) <= 1))

    def of(lines: Column, found: Column) -> Column:
        opening = trimmed(F.array_join(F.slice(lines, F.lit(1), found[0]["at"]), "\n"))
        first = F.filter(F.array(opening), lambda x: F.length(x) > 100)
        return F.when(F.size(found) == 0, unheaded(paragraphs(F.array_join(lines, "\n")))).otherwise(F.concat(unheaded(first), F.filter(following(lines, found), told)))

    return let(lines_of(F.coalesce(text, F.lit(""))), lambda lines: let(F.transform(lines, trimmed), lambda bare: let(heads(bare, lambda line, i: plain_heading(bare, line, i)), lambda found: of(lines, found))))


def markdown_sections(text: Column) -> Column:
    """heading, level and text of each # heading, marks of emphasis and links off the headings."""
    of = lambda line, i: (F.when(line.rlike(MARKED), trimmed(F.regexp_replace(F.regexp_extract(line, MARKED, 2), r"[#*_`\[\]]", ""))), F.length(F.regexp_extract(line, MARKED, 1)))
    return let(F.transform(lines_of(F.coalesce(text, F.lit(""))), lambda line: F.regexp_replace(line, r"\r$", "")), lambda lines: let(heads(lines, of), lambda found: following(lines, found)))


def strict_heading(bare: Column) -> Column:
    """A heading of a PDF's text: numbered or in capitals, and nothing that belongs to code, citations or page marks."""
    odd = bare.rlike(r"[{}()<>=;+]") | bare.rlike(rf"{SPACE}v\.{SPACE}") | bare.rlike(rf"Ibid|p\.{SPACE}*[0-9]") | bare.rlike("^[0-9]{1,4}$") | bare.rlike(rf"(?i)^page{SPACE}+[0-9]") | bare.rlike("[;,]$")
    numbered = bare.rlike(rf"^[0-9]+(?:\.[0-9]+)*{SPACE}")
    capitals = bare.rlike(CAPITALS) & (F.length(bare) < 60)
    return F.length(bare).between(3, 100) & ~odd & (~bare.rlike("[0-9]") | numbered) & (bare.rlike(rf"^[0-9]+(?:\.[0-9]+)*{SPACE}+[A-Z]") | capitals)


def pdf_sections(text: Column, opening_of: int = 200, words: int = 100) -> Column:
    """heading, level and text of a PDF's text by strict headings; openings over ``opening_of`` characters first, parts under ``words`` words joined to the one before."""

    def heading(line: Column, i: Column) -> tuple[Column, Column]:
        marked = F.startswith(line, F.lit("## "))
        usable = F.length(line).between(3, 120) & ~line.rlike("[{}()<>]") & ~line.rlike("^[0-9]{1,4}$") & ~line.rlike(rf"(?i)^page{SPACE}+[0-9]")
        told = trimmed(F.when(marked, F.substring(line, F.lit(4), F.length(line))).when(usable & line.rlike(PDF_NUMBERED), F.regexp_extract(line, PDF_NUMBERED, 2)).when(usable & line.rlike(CAPITALS), line))
        number = F.regexp_extract(line, PDF_NUMBERED, 1)
        return F.when(strict_heading(told), told), F.when(marked | (number == ""), 1).otherwise(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)

    def joined(parts: Column) -> Column:
        """Small parts with a heading go to the one before, heading and all."""

        def step(done: Column, part: Column) -> Column:
            small = part["heading"].isNotNull() & (F.size(words_of(part["text"])) < words) & (F.size(done) > 0)
            last = F.element_at(done, -1)
            whole = F.struct(last["heading"], last["level"], trimmed(F.concat_ws("\n", last["text"], part["heading"], part["text"])).alias("text")).cast(PART)
            return F.when(small, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(whole))).otherwise(F.concat(done, F.array(part)))

        return F.aggregate(parts, F.array().cast(PARTS), step)

    def of(lines: Column, found: Column) -> Column:
        opening = trimmed(F.array_join(F.slice(lines, F.lit(1), F.coalesce(F.get(found, F.lit(0))["at"], F.lit(0))), "\n"))
        first = F.filter(F.array(opening), lambda x: F.length(x) > opening_of)
        return joined(F.concat(unheaded(first), following(lines, found)))

    bare = lambda lines: F.transform(lines, trimmed)
    return let(F.filter(lines_of(F.coalesce(text, F.lit(""))), lambda x: ~trimmed(x).rlike(PAGE_MARK)), lambda lines: let(heads(bare(lines), heading), lambda found: of(lines, found)))


def looks_like_heading(bare: Column) -> Column:
    """Marked, numbered, a usual name of a section, or in capitals; the line is trimmed already."""
    capitals = (F.upper(bare) == bare) & bare.rlike("[A-Z]") & F.length(bare).between(4, 60)
    return (bare != "") & (F.length(bare) <= 120) & (bare.rlike(MARKED_AT_ALL) | bare.rlike(NUMBERED_AT_ALL) | bare.rlike(NAMED) | capitals)


def clean_heading(line: Column) -> Column:
    """Without its marks and number."""
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(line), rf"^#+{SPACE}*", ""), rf"^[0-9]+(?:\.[0-9]+)*\.?{SPACE}*", ""))


def headed_parts(text: Column) -> Column:
    """heading and text of what stands before, between and after headings, where there is any; fewer than two such parts are none."""

    def of(lines: Column, found: Column) -> Column:
        opening = unheaded(F.array(trimmed(F.array_join(F.slice(lines, F.lit(1), F.coalesce(F.get(found, F.lit(0))["at"], F.lit(0))), "\n"))))
        return let(F.filter(F.concat(opening, following(lines, found)), lambda p: p["text"] != ""), lambda parts: F.when((F.size(found) > 0) & (F.size(parts) > 1), parts).otherwise(F.array().cast(PARTS)))

    heading = lambda line, i: (F.when(looks_like_heading(line), clean_heading(line)), F.lit(1))
    return let(lines_of(trimmed(F.coalesce(text, F.lit("")))), lambda lines: let(heads(F.transform(lines, trimmed), heading), lambda found: of(lines, found)))


def joined_lines(text: Column) -> Column:
    """A line that ends without punctuation takes in the next, unless either is a heading, a list item or blank.

    Whether a line may take in its next depends on three lines alone; that a line taken in takes in none itself is left to
    one regular expression over the lines, each ended by a mark of what it may do. U+0001 and U+0002 are those marks, and
    are dropped from the text."""

    def ended(bare: Column, line: Column, i: Column) -> Column:
        own, after, before = F.get(bare, i), F.coalesce(F.get(bare, i + 1), F.lit("")), F.coalesce(F.get(bare, i - 1), F.lit(""))
        heading = (before == "") & F.length(own).between(3, 79) & own.rlike("^[A-Z]") & ~own.rlike("[.;,]$") & (F.size(words_of(own)) <= 10) & (F.length(after) > F.length(own))
        alone = (own == "") | (after == "") | F.startswith(own, F.lit("## ")) | heading | own.rlike(ENDS) | any_of(after, APART)
        right = F.rtrim(line, F.lit(" \t\n\r\f\x0B"))
        return F.when(alone, F.concat(right, F.lit("\x02"))).otherwise(F.concat(right, F.lit(" \x01")))

    marked = let(lines_of(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\x01")), F.lit("\x02"))), lambda lines: let(F.transform(lines, trimmed), lambda bare: F.array_join(F.transform(lines, lambda line, i: ended(bare, line, i)), "")))
    walked = F.regexp_replace(marked, r"([^\x01\x02]*)(?:\x01[ \t\n\r\f\x0B]*([^\x01\x02]*?) ?[\x01\x02]|\x02)", "$1$2\n")
    return F.regexp_replace(walked, r"\n\z", "")


def without_back_matter(text: Column) -> Column:
    """Cut before the last line of the second half with which references, an index or the like begin."""

    def cut(lines: Column) -> Column:
        bare = F.transform(lines, lambda x, i: F.struct(i.alias("at"), trimmed(F.regexp_replace(trimmed(x), PAGE_MARK, "")).alias("line")))
        late = F.filter(bare, lambda x: x["at"] >= F.floor(F.size(lines) * 0.5))
        found = F.filter(late, lambda x: any_of(x["line"], BACK_MATTER) | (x["line"].rlike(LATE_BACK_MATTER) & (x["at"] > F.size(lines) * 0.7)))
        return let(found, lambda h: F.when(F.size(h) > 0, trimmed(F.array_join(F.slice(lines, F.lit(1), F.element_at(h, -1)["at"]), "\n"))).otherwise(F.array_join(lines, "\n")))

    return let(lines_of(text), cut)


def title_guess(text: Column) -> Column:
    """The first line that isn't blank or a page mark, if it is 5 to 250 characters long and begins with no digit."""
    first = F.get(F.filter(F.transform(lines_of(text), trimmed), lambda x: (x != "") & ~x.rlike(PAGE_MARK)), F.lit(0))
    return let(trimmed(F.regexp_replace(first, rf"^##{SPACE}+", "")), lambda x: F.when(F.length(x).between(5, 250) & ~x.rlike("^[0-9]"), x))
