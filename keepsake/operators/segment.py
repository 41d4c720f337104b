"""Cutting texts: chunks of messages and documents, sections for extraction.

Each cut depends on what was cut before it, so these are table functions: one text in, rows out as they are cut, with
places in the source and sizes carried along instead of counted anew. ``register`` gives them to SQL:

    SELECT d.document_id, c.* FROM documents d, LATERAL keepsake_chunks(d.content, 150, 250) c
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lines import headed_parts
from ..functions.text import trimmed
from ..schema import CHUNK_TOKENS, MAX_SECTIONS, MIN_SECTION_CHARS, SECTION_CHARS, SINGLE_SECTION_CHARS

CHUNK = "chunk_index int, chunk string, start long, end long, token_estimate int, split_method string"
SECTION = "section_index int, heading string, section string"
Span = tuple[int, int, int]  # start, end, tokens

BLANK_LINES = re.compile(r"\n\n+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
SENTENCE = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+$")
WORD = re.compile(r"\S+")


def tokens(text: str, light: bool = False) -> int:
    """As the column expressions of the same name estimate them."""
    long = 1 if light else 0
    return sum(1 + (len(w) // 4 - long if len(w) > 6 else 0) + (not light and len(w) > 12) for w in text.split())


def between(text: str, mark: re.Pattern, start: int, end: int, light: bool = False) -> Iterator[Span]:
    """What lies between the marks and isn't blank."""
    for m in mark.finditer(text, start, end):
        if text[start : m.start()].strip():
            yield start, m.start(), tokens(text[start : m.start()], light)
        start = m.end()
    if text[start:end].strip():
        yield start, end, tokens(text[start:end], light)


class Held:
    """Parts of a text that go into one chunk if nothing too large follows."""

    def __init__(self, text: str, joiner: str, method: str):
        self.text, self.joiner, self.method, self.parts, self.size = text, joiner, method, [], 0

    def add(self, part: Span) -> None:
        self.parts.append(part)
        self.size += part[2]

    def taken(self) -> tuple[str, int, int, int, str]:
        """The chunk: text, start, end, tokens, method; nothing is held afterwards."""
        chunk = self.joiner.join(self.text[a:b] for a, b, _ in self.parts).strip()
        (a, b, _), (c, d, _) = self.parts[0], self.parts[-1]
        start, end = b - len(self.text[a:b].lstrip()), c + len(self.text[c:d].rstrip())
        out = chunk, start, end, self.size, self.method
        self.parts, self.size = [], 0
        return out


def filled(text: str, parts: Iterator[Span], most: int, joiner: str, method: str, smaller=None) -> Iterator[tuple]:
    """Parts joined as long as their sizes fit; one too large by itself is left to ``smaller``. The last chunk is yielded as what is held."""
    held = Held(text, joiner, method)
    for part in parts:
        if smaller and part[2] > most:
            if held.parts:
                yield held.taken()
            yield from smaller(part)
            continue
        if held.parts and held.size + part[2] > most:
            yield held.taken()
        held.add(part)
    if held.parts:
        yield held


def settled(chunks: Iterator[tuple]) -> Iterator[tuple]:
    for c in chunks:
        yield c.taken() if isinstance(c, Held) else c


def words_of(text: str, span: Span, most: int) -> Iterator[tuple]:
    parts = ((m.start(), m.end(), tokens(m[0])) for m in WORD.finditer(text, span[0], span[1]))
    for chunk, start, end, size, method in settled(filled(text, parts, most, " ", "word")):
        yield chunk, start, end, size, "forced" if size > most else method


def sentences_of(text: str, span: Span, most: int) -> Iterator[tuple]:
    return settled(filled(text, between(text, SENTENCE_END, span[0], span[1]), most, " ", "sentence", lambda s: words_of(text, s, most)))


def chunks(text: str, least: int = CHUNK_TOKENS[0], most: int = CHUNK_TOKENS[1]) -> Iterator[tuple]:
    """Paragraphs joined up to ``most`` tokens, long ones cut at sentences and those at words; a small rest joins the chunk before it if both fit."""
    size = tokens(text)
    if size <= most:
        if text:
            yield text, 0, len(text), size, "paragraph"
        return
    before = None
    for c in filled(text, between(text, BLANK_LINES, 0, len(text)), most, "\n\n", "paragraph", lambda p: sentences_of(text, p, most)):
        if isinstance(c, Held):
            c = c.taken()
            if before and c[3] < least and before[3] + c[3] <= most:
                before, c = (f"{before[0]}\n\n{c[0]}", before[1], c[2], before[3] + c[3], before[4]), None
        if before:
            yield before
        before = c
    if before:
        yield before


def light_chunks(text: str, most: int = CHUNK_TOKENS[1], cut: bool = False) -> Iterator[tuple]:
    """Paragraphs joined up to ``most`` lightly estimated tokens; ``cut``: longer ones at their sentences, a last one without its stop among them."""
    size = tokens(text, True)
    if size <= most:
        if text:
            yield text, 0, len(text), size, "paragraph"
        return

    def sentences(span: Span) -> Iterator[tuple]:
        parts = ((m.start(), m.end(), tokens(m[0], True)) for m in SENTENCE.finditer(text, span[0], span[1]) if m[0].strip())
        return settled(filled(text, parts, most, "", "sentence"))

    yield from settled(filled(text, between(text, BLANK_LINES, 0, len(text), True), most, "\n\n", "paragraph", sentences if cut else None))


class Chunks:
    """Rows of a text's chunks; places count characters, and the source between them is the chunk but for white space where parts meet."""

    def eval(self, text: str, least: int, most: int):
        for i, c in enumerate(chunks(text or "", least, most)):
            yield i, *c


class LightChunks:
    def eval(self, text: str, most: int, cut: bool):
        for i, c in enumerate(light_chunks(text or "", most, cut)):
            yield i, *c


# ---------------------------------------------------------------- sections

PARAGRAPH_END = re.compile(r"\n\s*\n")


def hard_split(text: str, cap: int) -> Iterator[str]:
    """Pieces of about ``cap`` characters at most: after the last full stop, else at the last line end, of the second half."""
    at = 0
    while len(text) - at > cap:
        stop, line = text.rfind(". ", at, at + cap + 2) - at, text.rfind("\n", at, at + cap + 1) - at
        cut = stop + 1 if stop >= cap * 0.5 else line + 1 if line >= cap * 0.5 else cap
        if piece := text[at : at + cut].strip():
            yield piece
        at += cut
        while at < len(text) and text[at].isspace():
            at += 1
    if rest := text[at:].strip():
        yield rest


def packed_paragraphs(paragraphs: list[str], cap: int) -> Iterator[str]:
    """Paragraphs joined by line ends up to the cap, longer ones cut."""
    held, size = [], 0
    for p in paragraphs:
        if held and (len(p) > cap or size + len(p) + 2 > cap):
            yield "\n".join(held)
            held, size = [], 0
        if len(p) > cap:
            yield from hard_split(p, cap)
        else:
            size += len(p) + (1 if held else 0)
            held.append(p)
    if held:
        yield "\n".join(held)


def merged_to_limit(lengths: list[int], most: int, cap: int) -> list[tuple[int, int]]:
    """Runs (first, last) of neighbours: while there are more than ``most``, the smallest adjoining pair that fits the cap becomes one, the first of equal ones.

    Pairs wait in a heap; those that have changed since are skipped when they come up."""
    n = len(lengths)
    size, last, following, before = list(lengths), list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = [(size[i] + size[i + 1] + 2, i, i + 1, i + 1) for i in range(n - 1) if size[i] + size[i + 1] + 2 <= cap]
    heapq.heapify(pairs)
    left = n
    while left > most and pairs:
        both, i, j, end = heapq.heappop(pairs)
        if size[i] is None or size[j] is None or following[i] != j or last[j] != end or size[i] + size[j] + 2 != both:
            continue
        size[i], size[j], last[i], following[i] = both - 1, None, last[j], following[j]
        if following[i] < n:
            before[following[i]] = i
        left -= 1
        for a, b in ((before[i], i), (i, following[i])):
            if a >= 0 and b < n and size[a] + size[b] + 2 <= cap:
                heapq.heappush(pairs, (size[a] + size[b] + 2, a, b, last[b]))
    return [(i, last[i]) for i in range(n) if size[i] is not None]


def sections(text: str, parts: list[tuple[str | None, str]], cap: int = SECTION_CHARS, least: int = MIN_SECTION_CHARS, most: int = MAX_SECTIONS, single: int = SINGLE_SECTION_CHARS) -> Iterator[tuple[str | None, str]]:
    """What goes to extraction at once: the whole of a short text; else its headed ``parts``, cut to the cap, small ones joined to the one before, merged to ``most``; without parts, windows of paragraphs."""
    text = text.strip()
    if len(text) <= single:
        yield None, text
        return
    top = cap * 12 // 10
    split = lambda t: [p.strip() for p in PARAGRAPH_END.split(t) if p.strip()]

    def cut() -> Iterator[tuple[str | None, str]]:
        """Parts with those beyond the top in pieces; pieces can be beyond it no more."""
        if not parts:
            for piece in packed_paragraphs(split(text), cap):
                yield None, piece
        for heading, body in parts:
            if len(body) <= top:
                yield heading, body
                continue
            paragraphs = split(body)
            for i, piece in enumerate(packed_paragraphs(paragraphs, cap) if len(paragraphs) > 1 else hard_split(body, cap)):
                yield heading if not i else f"{heading or 'Section'} (cont.)", piece

    headings: list[str | None] = []
    bodies: list[list[str]] = []
    sizes: list[int] = []
    for heading, body in cut():
        if len(body) < least and sizes and sizes[-1] + len(body) + 2 <= top:
            bodies[-1].append(body)
            sizes[-1] += len(body) + 1
            headings[-1] = headings[-1] or heading
        else:
            headings.append(heading)
            bodies.append([body])
            sizes.append(len(body))
    for first, last in merged_to_limit(sizes, most, top) if parts else [(i, i) for i in range(len(sizes))]:
        yield next((h for h in headings[first : last + 1] if h is not None), None), "\n".join(x for b in bodies[first : last + 1] for x in b)


class Sections:
    def eval(self, text: str, parts: list, cap: int, least: int, most: int, single: int):
        for i, s in enumerate(sections(text or "", [(p["heading"], p["text"]) for p in parts or []], cap, least, most, single)):
            yield i, *s


# ---------------------------------------------------------------- as tables

TABLE_FUNCTIONS = {"keepsake_chunks": (Chunks, CHUNK), "keepsake_light_chunks": (LightChunks, CHUNK), "keepsake_sections": (Sections, SECTION)}


def register(spark: SparkSession) -> None:
    """The table functions under their names in SQL."""
    for name, (kind, returns) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(kind, returnType=returns, useArrow=True))


def laterally(df: DataFrame, name: str, *arguments: Column) -> DataFrame:
    """The rows of ``df`` with those that a table function gives for each."""
    kind, returns = TABLE_FUNCTIONS[name]
    return df.lateralJoin(F.udtf(kind, returnType=returns, useArrow=True)(*(a.outer() for a in arguments)))


def chunked(df: DataFrame, text: str = "content", least: int = CHUNK_TOKENS[0], most: int = CHUNK_TOKENS[1]) -> DataFrame:
    """A row per chunk: the other columns and those of ``CHUNK``."""
    return laterally(df, "keepsake_chunks", F.col(text), F.lit(least), F.lit(most)).drop(text)


def lightly_chunked(df: DataFrame, text: str = "content", most: int = CHUNK_TOKENS[1], cut: bool = False) -> DataFrame:
    return laterally(df, "keepsake_light_chunks", F.col(text), F.lit(most), F.lit(cut)).drop(text)


def sectioned(df: DataFrame, text: str = "content", cap: int = SECTION_CHARS, least: int = MIN_SECTION_CHARS, most: int = MAX_SECTIONS, single: int = SINGLE_SECTION_CHARS) -> DataFrame:
    """A row per section: the other columns, section_index, heading, section; headings are found in the JVM, and only in texts that are cut."""
    parts = F.when(F.length(trimmed(F.col(text))) > single, headed_parts(F.col(text)))
    return laterally(df.withColumn("__parts", parts), "keepsake_sections", F.col(text), F.col("__parts"), *(F.lit(x) for x in (cap, least, most, single))).drop(text, "__parts")
