"""Text: keys and labels, counts, cleaning, line filters and predicates over concepts.

Patterns spell out ASCII classes, so that they mean the same in every regular expression engine."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f\x0B]"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once a row: inside a lambda an expression is computed anew for each element."""
    return F.transform(F.array(value), use)[0]


def each(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, text)


def where(text: Column, looks, change) -> Column:
    """change(text) for the texts that it may concern; a look is cheaper than a change."""
    return let(text, lambda t: F.when(looks(t), change(t)).otherwise(t))


def each_where(text: Column, steps: list[tuple[str, str]], pieces: tuple[str | None, ...]) -> Column:
    """The same as each, where a step's text must hold its piece, or without one match its pattern."""
    for (pattern, put), piece in zip(steps, pieces, strict=True):
        looks = (lambda t, p=pattern: t.rlike(p)) if piece is None else (lambda t, p=piece: F.contains(t, F.lit(p)))
        text = where(text, looks, lambda t, p=pattern, r=put: F.regexp_replace(t, p, r))
    return text


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\f\x0B"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


# ---------------------------------------------------------------- keys and labels

#: Endings that a key leaves out, in the order in which they are tried.
KEY_SUFFIXES = (" system", " module", " approach", " method", " technique", " tool", " framework", " library", " platform", " service", " component", " feature")


def normalize_key(label: Column) -> Column:
    """Lower case, endings off, only letters and digits, words sorted and joined by underscores."""
    # a fold, since nested conditions would repeat the text three times for each ending
    key = F.aggregate(F.array(*map(F.lit, KEY_SUFFIXES)), trimmed(F.lower(label)), lambda k, s: F.when(F.endswith(k, s), F.substring(k, F.lit(1), F.length(k) - F.length(s))).otherwise(k))
    return F.array_join(F.array_sort(words_of(F.regexp_replace(key, rf"[^a-z0-9 \t\n\r\f\x0B]", ""))), "_")


def normalize_label(label: Column) -> Column:
    """Lower case without punctuation, single spaces."""
    return F.trim(each(F.lower(label), [(r"[^a-z0-9 \t\n\r\f\x0B]", ""), (rf"{SPACE}+", " ")]))


def sorted_key(label: Column, joiner: str = "_") -> Column:
    """Like a key, but with its endings; joined by an underscore (ingestion) or a space (seeding)."""
    return F.array_join(F.array_sort(words_of(F.regexp_replace(F.lower(label), r"[^a-z0-9 \t\n\r\f\x0B]", ""))), joiner)


def search_label(label: Column) -> Column:
    """Anything but letters and digits becomes one space."""
    return F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " "))


def display_domain(domain: Column) -> Column:
    return F.initcap(F.regexp_replace(domain, "[-_]+", " "))


# ---------------------------------------------------------------- counts


def token_estimate(text: Column) -> Column:
    """A token a word, more for words over 6 and over 12 characters."""
    return F.aggregate(words_of(text), F.lit(0).cast("long"), lambda n, w: n + 1 + F.when(F.length(w) > 6, F.floor(F.length(w) / 4)).otherwise(F.lit(0).cast("long")) + F.when(F.length(w) > 12, 1).otherwise(0))


def token_estimate_light(text: Column) -> Column:
    return F.aggregate(words_of(text), F.lit(0).cast("long"), lambda n, w: n + 1 + F.when(F.length(w) > 6, F.floor(F.length(w) / 4) - 1).otherwise(F.lit(0).cast("long")))


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def paragraph_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, rf"\n{SPACE}*\n"), lambda p: trimmed(p) != "")).cast("long")


def citation_count(text: Column) -> Column:
    """Distinct numbers in square brackets."""
    groups = F.regexp_extract_all(text, F.lit(r"(\[[0-9]+(?:[, \-]+[0-9]+)*\])"), F.lit(1))
    return F.size(F.array_distinct(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit("([0-9]+)"), F.lit(1)))))).cast("long")


def required_concepts(words: Column) -> Column:
    return F.when(words < 500, 1).when(words < 3000, 3).otherwise(10)


def target_concepts(words: Column) -> Column:
    return F.least(F.greatest(F.floor(words / 350.0 + 0.5), F.lit(3)), F.lit(12)).cast("int")


#: Frequent words of the languages that are told apart, in order of precedence.
LANGUAGE_WORDS = {
    "en": ("the", "and", "for", "that", "this", "with", "from", "have", "are", "was"),
    "es": ("el", "la", "los", "las", "del", "por", "que", "con", "una", "para"),
    "fr": ("les", "des", "une", "est", "que", "pour", "dans", "par", "sur", "pas"),
    "de": ("der", "die", "und", "ist", "von", "den", "das", "nicht", "sich", "auf"),
}


def detect_language(text: Column, sample: int = 2000) -> Column:
    """Most of its frequent words in the first ``sample`` characters; the earlier language at a tie, English without any."""
    words = F.array_distinct(F.split(F.lower(F.substring(text, 1, sample)), rf"{SPACE}+"))
    scores = F.array(*(F.size(F.array_intersect(words, F.array(*map(F.lit, ws)))) for ws in LANGUAGE_WORDS.values()))
    return F.element_at(F.array(*map(F.lit, LANGUAGE_WORDS)), F.array_position(scores, F.array_max(scores)).cast("int"))


#: Patterns of which one shows that a text has such a part.
STRUCTURE = {
    "has_references": (r"(?im)(?:^|\n)\s*(?:references|bibliography|works\s+cited)\s*$",),
    "has_formulas": (r"\$[^$]+\$", r"\\frac\{|\\sum\b|\\int\b", "[∑∏∫∂∇√∞≈≠≤≥±]"),
    "has_code": (r"(?s)```.*?```", r"(?:^|\n)(?:def |class |import |from |function |const |let |var )"),
    "has_tables": (r"\|[^|]+\|[^|]+\|", r"\t[^\t]+\t[^\t]+\t"),
    "has_images": (r"(?i)fig(?:ure)?\.?\s*[0-9]+",),
}
NUMBERED_SECTION = r"(?m)^([0-9]+\.\s+[A-Z])"


def structure_flags(text: Column) -> dict[str, Column]:
    flags = {name: reduce(Column.__or__, (text.rlike(p) for p in patterns)) for name, patterns in STRUCTURE.items()}
    return flags | {"has_numbered_sections": F.size(F.regexp_extract_all(text, F.lit(NUMBERED_SECTION), F.lit(1))) >= 2}


# ---------------------------------------------------------------- cleaning

#: Markup of messages and what becomes of it; links keep their words, images go.
MARKDOWN = [
    (r"(?s)```.*?```", " "),
    (r"`([^`\n]+)`", "$1"),
    (r"(?m)^#{1,6}[ \t]+", ""),
    (r"\*{1,3}([^*]+)\*{1,3}", "$1"),
    (r"_{1,3}([^_]+)_{1,3}", "$1"),
    (r"!\[([^\]]*)\]\([^)]+\)", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?m)^>[ \t]+", ""),
    (r"(?m)^[-*+][ \t]+", ""),
    (r"(?m)^[0-9]+\.[ \t]+", ""),
    (r"\|", " "),
    (r"---+", " "),
    (r"\n{3,}", "\n\n"),
    (r"[ \t]{2,}", " "),
]
#: The same for documents, whose code keeps its body.
DOCUMENT_MARKDOWN = [
    (r"(?s)```[A-Za-z0-9_]*\n?(.*?)```", "$1"),
    (r"`([^`\n]+)`", "$1"),
    (r"(?m)^#{1,6}[ \t]+", ""),
    (r"\*{1,3}([^*]+)\*{1,3}", "$1"),
    (r"_{1,3}([^_]+)_{1,3}", "$1"),
    (r"!\[([^\]]*)\]\([^)]+\)", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?m)^>[ \t]+", ""),
    (r"(?m)^[-*+][ \t]+", "  "),
    (r"(?m)^[0-9]+\.[ \t]+", "  "),
    (r"---+", ""),
    (r"\|", " "),
]
#: Markup of HTML and what becomes of it.
HTML = [
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</p>", "\n\n"),
    (r"(?i)</(div|li|tr)>", "\n"),
    (r"(?i)</td>", " | "),
    (r"<[^>]+>", ""),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    (r"\n{3,}", "\n\n"),
]
#: White space and what becomes of it.
WHITE_SPACE = [
    ("\r\n", "\n"),
    ("[\r\f]", "\n"),
    ("\u00a0", " "),
    ("[\u200b\u200c\u200d\ufeff]", ""),
    (r"[ \t]+(\n|$)", "$1"),
    (r"\n{4,}", "\n\n"),
    (" {2,}", " "),
    (r"\t+", " "),
]


def tidy_lines(text: Column) -> Column:
    """Lines trimmed, blank ones left out, single spaces."""
    lines = F.filter(F.transform(lines_of(text), trimmed), lambda x: x != "")
    return F.trim(each_where(F.array_join(lines, "\n"), [(r"[ \t]{2,}|\t", " ")], (None,)))


def clean_message(text: Column) -> Column:
    return tidy_lines(each(text, MARKDOWN))


def clean_document(text: Column, markdown: bool = False) -> Column:
    return tidy_lines(each_where(text, DOCUMENT_MARKDOWN, ("```", "`", "#", "*", "_", "![", "](", ">", None, None, "---", "|")) if markdown else text)


def strip_html(html: Column) -> Column:
    return each(html, HTML)


#: Typographic characters and their plain forms.
PLAIN_FORMS = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st",
    "–": "-", "—": " -- ", "…": "...", "·": " ", "•": " ", "−": "-", "×": "x", "÷": "/", "≤": "<=", "≥": ">=", "≠": "!=", "≈": "~",
    "∞": "infinity", "∑": "sum", "∏": "prod", "∫": "integral", "∂": "partial", "∇": "nabla", "√": "sqrt",
}
#: UTF-8 read as Latin-1, and what it stood for.
MOJIBAKE = {"â\u0080\u0099": "'", "â\u0080\u009c": '"', "â\u0080\u009d": '"', "â\u0080\u0098": "'", "â\u0080\u0093": "-", "â\u0080\u0094": " -- ", "â\u0080¦": "...", "Â\u00a0": " "}
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
FULL_WIDTH_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


#: Every character but ASCII (with DEL) and the letters and signs below U+0250 that stay as they are.
UNPLAIN = "[\x7f-\u00a0\u00ad\u00b7\u00d7\u00f7\u0250-\U0010ffff]"
QUOTES, QUOTES_PLAIN = "“”„‟″‶‘’‚‛′‵\u00a0", "\"\"\"\"\"\"'''''' "
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


def plain_characters(text: Column) -> Column:
    """Ligatures, quotes, dashes, signs, broken encodings, invisible and full-width characters in plain form."""

    def plain(t: Column) -> Column:
        for bad, good in {**MOJIBAKE, **PLAIN_FORMS}.items():
            t = F.replace(t, F.lit(bad), F.lit(good))
        t = where(t, lambda x: x.rlike(f"[{QUOTES}]"), lambda x: F.translate(x, QUOTES, QUOTES_PLAIN))
        t = F.regexp_replace(t, "[\u00ad\u200b-\u200f\ufeff\u2060\u180e\ufffd]", "")
        return where(F.regexp_replace(t, CONTROLS, ""), lambda x: x.rlike("[\uff01-\uff5e]"), lambda x: F.translate(x, FULL_WIDTH, FULL_WIDTH_PLAIN))

    return let(text, lambda t: F.when(t.rlike(UNPLAIN), plain(t)).otherwise(each_where(t, [(CONTROLS, "")], (None,))))


def tidy_white_space(text: Column) -> Column:
    text = where(text, lambda t: t.rlike("[\r\f\u00a0\u200b\u200c\u200d\ufeff]"), lambda t: each(t, WHITE_SPACE[:4]))
    return trimmed(each_where(text, WHITE_SPACE[4:], (None, "\n\n\n\n", "  ", "\t")))


def dehyphenated(text: Column) -> Column:
    return where(text, lambda t: t.rlike(r"-\s*\n"), lambda t: F.regexp_replace(t, r"([A-Za-z0-9_]{3,})-\s*\n\s*([A-Za-z0-9_]{2,})", "$1$2"))


#: Whole lines that carry no content.
PAGE_NUMBERS = (r"^-?\s*[0-9]{1,4}\s*-?$", r"^Page\s+[0-9]{1,4}\s*(?:of\s+[0-9]{1,4})?$", r"^[0-9]{1,4}\s*/\s*[0-9]{1,4}$", r"^--\s*[0-9]+\s+of\s+[0-9]+\s*--$", r"^[0-9]+\s+of\s+[0-9]+$")
WATERMARKS = (r"(?i)\b(?:DRAFT|CONFIDENTIAL|DO NOT DISTRIBUTE|PREPRINT|WORKING PAPER)\b", r"(?i)\b(?:Accepted|Published|Copyright)\s+(?:version|manuscript|article)", r"(?i)\b(?:arXiv|bioRxiv|medRxiv|SSRN)\s*:\s*[0-9]+\.[0-9]+")
NOISE = (
    r"doi:\s*\S+$", r"https?://\S+$", r"downloaded\s+from", r"published\s+(?:by|online)\s", r"all\s+rights\s+reserved", r"this\s+article\s+is\s+(?:published|available|distributed)",
    r"(?:received|revised|accepted|published):\s*[0-9]", r"article\s+history", r"(?:international\s+)?journal\s+of", r"proceedings\s+of\s+(?:the\s+)?[A-Za-z0-9_]", r"transactions\s+on\s+[A-Za-z0-9_]",
    r"(?:ieee|acm)\s+[A-Za-z0-9_]", r"(?:springer|elsevier|wiley)\b", r"[0-9]{1,3}\s*$", r"page\s+[0-9]+", r"[0-9]+\s+of\s+[0-9]+$", r"vol(?:\.|ume)\s*[0-9]+", r"issn\s+[0-9-]", r"isbn\s+[0-9-]+$",
    r"\*?\s*corresponding?\s+author", r"e-?mail:\s*\S+@\S+$", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+$", r"[0-9]+\s+(?:department|faculty|school|institute|laboratory|center|centre)\s+of", r"(?:university|institut[eo]?|college)\s+",
    r"preprint\s+", r"submitted\s+to\s+", r"accepted\s+by\s+", r"appears?\s+in\s+", r"presented\s+at\s+", r"(?:conference|symposium|workshop)\s+on\s+", r"supplementary\s+(?:material|information|data)", r"appendix\s+[a-z]?\s*$",
    r"fig(?:ure)?\.?\s*[0-9]+\s*[:.]?\s*$", r"table\s+[0-9]+\s*[:.]?\s*$", r"arxiv:[0-9]+\.[0-9]+", r"openreview\.net", r"url\s+https?:",
)
NOISE_PATTERN = "(?i)^(?:" + "|".join(NOISE) + ")"


def is_noise_line(line: Column) -> Column:
    """A line of the kinds above, or one of more than two words that are mostly numbers."""
    numbers = F.size(F.regexp_extract_all(line, F.lit(r"([0-9]+\.?[0-9]*)"), F.lit(1)))
    words = F.size(words_of(line))
    return (line != "") & (line.rlike(NOISE_PATTERN) | (line.rlike("[0-9]") & (words > 2) & (numbers / words > 0.6)))


def without_lines(text: Column, gone) -> Column:
    return F.array_join(F.filter(lines_of(text), lambda x: ~gone(trimmed(x))), "\n")


def without_noise(text: Column) -> Column:
    return without_lines(text, is_noise_line)


def without_page_numbers(text: Column) -> Column:
    return without_lines(text, lambda x: reduce(Column.__or__, (x.rlike(p) for p in PAGE_NUMBERS)))


def without_watermarks(text: Column) -> Column:
    """Lines of more than 80 characters stay."""
    return without_lines(text, lambda x: (F.length(x) <= 80) & reduce(Column.__or__, (x.rlike(p) for p in WATERMARKS)))


def without_repeated_lines(text: Column, share: float = 0.2, longest: int = 120) -> Column:
    """Drops lines of 3 to ``longest`` characters that occur three times and in that share of all lines at least.

    Equal lines are neighbours once sorted, so one fold over them finds the frequent ones."""

    def frequent(lines: Column) -> Column:
        usable = F.array_sort(F.filter(F.transform(lines, trimmed), lambda x: F.length(x).between(3, longest)))
        least = F.greatest(F.lit(3), F.floor(F.size(lines) * share).cast("int"))
        start = F.struct(F.lit("").alias("line"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("often"))

        def step(s: Column, x: Column) -> Column:
            n = F.when(s["line"] == x, s["n"] + 1).otherwise(1)
            return F.struct(x.alias("line"), n.alias("n"), F.when(n == s["least"], F.concat(s["often"], F.array(x))).otherwise(s["often"]).alias("often"), s["least"].alias("least"))

        return F.aggregate(usable, F.struct(start["line"].alias("line"), start["n"].alias("n"), start["often"].alias("often"), least.alias("least")), step)["often"]

    kept = lambda lines, often: F.filter(lines, lambda x: ~F.array_contains(often, trimmed(x)))
    return let(lines_of(text), lambda lines: let(frequent(lines), lambda often: F.array_join(F.when(F.size(often) > 0, kept(lines, often)).otherwise(lines), "\n")))


def clean_text(text: Column) -> Column:
    return tidy_white_space(plain_characters(text))


# ---------------------------------------------------------------- excerpts and previews


def cut_at_boundary(text: Column, most: int = 8000) -> Column:
    """At the last full stop, else the last space, if that lies beyond the half; else at ``most``."""
    head = F.substring(text, 1, most)
    last = lambda mark: most - F.locate(mark, F.reverse(head)) + 1
    has = lambda mark: F.locate(mark, head) > 0
    at = F.when(has(".") & (last(".") > most / 2), last(".")).when(has(" ") & (last(" ") > most / 2), last(" ") - 1).otherwise(F.lit(most))
    return F.when(F.length(text) <= most, text).otherwise(F.substring(head, F.lit(1), at))


def preview(text: Column, most: int = 80) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def title_of(text: Column, most: int = 50) -> Column:
    """At most ``most`` characters, cut back to a whole word."""
    flat = F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))
    head = F.substring(flat, 1, most)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("...")))


def window_chunks(text: Column, size: int = 1500, overlap: int = 200, least: int = 30) -> Column:
    """Windows of ``size`` characters, each ``overlap`` into the one before; those of up to ``least`` are left out."""
    step = size - overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda s: F.trim(F.substring(text, s + 1, F.lit(size)))), lambda c: F.length(c) > least)


# ---------------------------------------------------------------- concepts

#: Words of the predicates over labels and definitions.
STRUCTURAL_LABELS = ("conclusion", "conclusions", "related work", "references", "acknowledgments", "bibliography", "appendix", "table of contents", "abstract", "introduction", "overview", "summary")
GENERIC_WORDS = tuple("the and for that this with from into about within between through during their there these those which while where when what how why who does done being have has had also just only very much more most some any such each every both than then onto upon over under against among across after before because although however therefore thus hence process system concept model".split())
FRAGMENT_VERBS = tuple("is are was were be been being has have had does do did can could will would shall should may might manages manage retains retain utilizes utilize includes include provides provide allows allow enables enable uses use used using makes make helps help shows show describes describe contains contain requires require supports support".split())
CONNECTORS = tuple("for of the a an in on to with by that which from into about and or as at".split())


def literals(values) -> Column:
    """A constant array of texts; one literal, so that long lists are built quickly."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def is_one_of(word: Column, values) -> Column:
    """Like isin for plain words, as one literal."""
    return word.rlike("^(?:" + "|".join(values) + ")$")


def is_structural(label: Column) -> Column:
    return trimmed(F.lower(label)).isin(*STRUCTURAL_LABELS)


def letters(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[^a-z]", "")


def is_fragment(label: Column) -> Column:
    """A label that is a piece of a sentence rather than a name."""
    t = trimmed(label)

    def of_words(bare: Column) -> Column:
        n = F.size(bare)
        ends = F.coalesce(F.try_element_at(bare, F.lit(-1)).isin(*CONNECTORS), F.lit(False))
        verb = F.arrays_overlap(bare, literals(FRAGMENT_VERBS)) & (n >= 3)
        leads = t.rlike(r"(?i)^(it|this|that|these|those|there|here|they|we|you|he|she)\s+") & (n >= 3)
        return (n > 6) | ends | leads | verb | ((n == 1) & is_one_of(bare[0], GENERIC_WORDS))

    return (F.length(t) < 3) | (F.length(t) > 80) | t.rlike(r"[!?;]|,\s|\.\s") | let(F.transform(words_of(t), letters), of_words)


def content_words(text: Column) -> Column:
    return F.filter(F.split(normalize_label(text), " "), lambda w: (F.length(w) > 3) & ~is_one_of(w, GENERIC_WORDS))


def stem(word: Column) -> Column:
    return F.regexp_replace(letters(word), "(ing|tion|ment|ence|ance|ness|ity|ies|es|s)$", "")


#: Characters of a definition that are looked at first.
OPENING = 1000


def restates(label: Column, definition: Column) -> Column:
    """A definition that says little beyond its label.

    Four fresh words in its opening settle most definitions; of these the rest isn't taken apart."""
    root = stem(F.regexp_extract(definition, rf"(?i)^{SPACE}*(?:the\s+)?(?:process|act|practice|concept|idea|system|method|notion)\s+of\s+([a-z]+)", 1))
    low, whole = trimmed(F.lower(label)), F.lower(definition)
    short = F.length(definition) < 4 * F.length(low)  # lower case is never shorter
    copied = (F.length(low) >= 4) & F.when(short, (whole == low) | (F.contains(whole, low) & (F.length(whole) < 4 * F.length(low)))).when(~short, False)
    told = lambda ws: F.filter(ws, lambda w, i: (F.length(w) > 3) & ~is_one_of(w, GENERIC_WORDS) & (i < F.size(ws) - 1))  # noqa: E731, the last may be cut
    opening = let(F.split(normalize_label(F.substring(definition, 1, OPENING)), " "), told)

    def same(lab: Column, r: Column) -> Column:
        near = F.contains(F.array_join(lab, ""), r) | F.exists(lab, lambda w: F.startswith(w, r) | F.startswith(r, F.substring(w, 1, 4)) | (stem(w) == r))
        return (F.length(r) >= 3) & near

    def compared(lab: Column, words: Column, r: Column) -> Column:
        fresh = F.size(F.filter(words, lambda w: ~F.array_contains(lab, w)))
        shared = F.size(F.filter(lab, lambda w: F.array_contains(words, w)))
        overlap = F.when(F.size(lab) > 0, shared / F.size(lab)).otherwise(0.0)
        return (F.size(words) == 0) | (fresh < 3) | ((overlap >= 0.5) & (fresh < 4)) | same(lab, r)

    def settled(both: Column) -> Column:
        lab, r = both["label"], both["root"]
        fresh = F.size(F.filter(both["opening"], lambda w: ~F.array_contains(lab, w)))
        return F.when(fresh >= 4, same(lab, r)).otherwise(let(content_words(definition), lambda words: compared(lab, words, r)))

    return let(F.struct(content_words(label).alias("label"), opening.alias("opening"), root.alias("root")), settled) | copied


def is_low_quality(label: Column, definition: Column) -> Column:
    label, definition = F.coalesce(label, F.lit("")), F.coalesce(definition, F.lit(""))
    brief = F.when(F.length(trimmed(F.substring(definition, 1, OPENING))) >= 12, False).otherwise(F.length(trimmed(definition)) < 12)
    return (F.length(trimmed(label)) < 3) | brief | is_fragment(label) | restates(label, definition)


def concept_type(kind: Column) -> Column:
    """One of the seven types: exactly, by what it contains, else fact."""
    low = trimmed(F.lower(kind))
    out = F.when(kind.isNull(), "fact").when(low.isin("problem", "decision", "fact", "entity", "event", "preference", "code"), low)
    for name, parts in (("problem", "problem|issue|bug"), ("decision", "decision|choice|chose"), ("entity", "entity|person|org"), ("event", "event|happened|occurred"), ("preference", "prefer|like"), ("code", "code|function|api")):
        out = out.when(low.rlike(parts), name)
    return out.otherwise("fact")


def importance(value: Column) -> Column:
    """A whole number from 1 to 10; 5 where there is none."""
    number = F.regexp_extract(value.cast("string"), r"^\s*([+-]?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when(number.isNull(), 5).otherwise(F.least(F.greatest(F.floor(number + 0.5), F.lit(1)), F.lit(10))).cast("int")


def clean_string(value: Column, most: int = 1000) -> Column:
    """Trimmed, quotes around it off, single spaces, at most so long."""
    v = trimmed(F.coalesce(value, F.lit("")))
    for quote in ('"', "'"):
        v = F.when((F.length(v) > 1) & F.startswith(v, F.lit(quote)) & F.endswith(v, F.lit(quote)), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.substring(F.regexp_replace(v, rf"{SPACE}+", " "), 1, most)


def clean_label(value: Column) -> Column:
    v = F.substring(F.regexp_replace(F.replace(trimmed(F.coalesce(value, F.lit(""))), F.lit('"'), F.lit("")), rf"{SPACE}+", " "), 1, 120)
    return F.trim(each(v, [(r"^\s*[-*•]+\s+", ""), (r"^[0-9]+[.)]\s+", ""), (r"[.!?;]+$", "")]))


def concept_text(label: Column, definition: Column, significance: Column, related: Column) -> Column:
    """What is embedded for a concept."""
    return F.concat_ws(" ", F.concat(label, F.lit(": "), definition), F.when(F.length(significance) > 0, F.concat(F.lit("SIGNIFICANCE: "), significance)), F.when(F.size(related) > 0, F.concat(F.lit("RELATED: "), F.array_join(related, ", "))))


def clean_related(related: Column, most: int = 20) -> Column:
    return F.slice(F.filter(F.transform(related, lambda x: F.trim(F.regexp_replace(x, "^[\"']+|[\"']+$", ""))), lambda x: F.length(x).between(2, 120)), 1, most)


#: Other names of relation types.
RELATION_ALIASES = {
    "cause": "causes", "caused_by": "causes",
    "related": "related_to", "relates_to": "related_to", "associated_with": "related_to",
    "replaced_by": "replaces",
    "partof": "part_of", "member_of": "part_of", "contains": "part_of",
    "required_by": "requires", "depends_on": "requires",
    "evolvesinto": "evolves_into", "evolved_from": "evolves_into",
}


def relation_type(kind: Column, aliases: dict[str, str] = RELATION_ALIASES) -> Column:
    low = trimmed(F.lower(F.coalesce(kind, F.lit(""))))
    names = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.when(low.isin("causes", "related_to", "replaces", "part_of", "requires", "evolves_into"), low).otherwise(F.coalesce(names[low], F.lit("related_to")))


#: Words whose opposites contradict one another.
OPPOSITES = (("is", "is not"), ("can", "cannot"), ("does", "does not"), ("will", "will not"), ("should", "should not"), ("always", "never"), ("increases", "decreases"), ("enables", "disables"), ("true", "false"), ("correct", "incorrect"), ("valid", "invalid"))


def contradicts(old: Column, new: Column) -> Column:
    a, b = F.lower(old), F.lower(new)
    either = reduce(Column.__or__, ((F.contains(a, F.lit(p)) & F.contains(b, F.lit(n))) | (F.contains(a, F.lit(n)) & F.contains(b, F.lit(p))) for p, n in OPPOSITES))
    return (a != b) & either


# ---------------------------------------------------------------- domains and fields

#: Patterns of the domains, in order of precedence.
DOMAINS = {
    "computer-science": (r"neural\s*network|machine\s*learning|deep\s*learning|transformer|gradient\s*descen", r"\b(?:algorithm|embedding|loss\s*function|batch\s*size|learning\s*rate|fine.?tun)\b", r"\b(?:software|architecture|api|database|compiler|runtime|kernel)\b", r"\b(?:neural|transformer|attention|encoder|decoder|tokenizer)\b"),
    "medicine": (r"\b(?:patient|clinical|diagnosis|treatment|therapeutic|dosage|symptom)\b", r"\b(?:patholog|disease|medical|surgery|pharmaceutical|vaccine)\b", r"\b(?:epidemiolog|oncolog|cardiol|neurol|immunol)\b"),
    "business": (r"\b(?:revenue|market\s*share|profit|loss|cash\s*flow|balance\s*sheet)\b", r"\b(?:investor|shareholder|dividend|stock|portfolio|asset)\b", r"\b(?:financial|investing|money|wealth|income|tax(?:es)?|corporation)\b", r"\b(?:entrepreneur|business\s*model|startup|venture|capital)\b", r"\b(?:marketing|brand|customer\s*acquisition|sales\s*funnel)\b", r"\b(?:budget|debt|credit|savings|insurance|retirement|mortgage)\b", r"\b(?:strategy|competitive|advantage|market\s*analysis)\b"),
    "humanities": (r"\b(?:apartheid|segregation|civil\s*rights|racism|discrimination)\b", r"\b(?:memoir|autobiography|biography|childhood|upbringing)\b", r"\b(?:history|culture|philosophy|literature|society|civilization)\b", r"\b(?:art|music|religion|ethics|aesthetic|sociology|anthropology)\b", r"\b(?:colonial|indigenous|ethnic|tribe|tradition|heritage)\b"),
    "law": (r"\b(?:court|legal|statute|contract|liability|jurisdiction|plaintiff)\b", r"\b(?:defendant|verdict|appeal|precedent|regulation|compliance)\b"),
    "mathematics": (r"\b(?:theorem|proof|lemma|conjecture|integral|derivative)\b", r"\b(?:eigenvalue|matrix|polynomial|topology|algebra)\b"),
    "physics": (r"\b(?:quantum|relativity|particle|gravitational|electromagnetic)\b", r"\b(?:thermodynamic|photon|electron|nuclear|optics)\b"),
    "chemistry": (r"\b(?:molecule|compound|reaction|synthesis|catalyst|polymer|bond)\b", r"\b(?:chemical|reagent|solvent|concentration|molar)\b"),
    "biology": (r"\b(?:cell|protein|gene|organism|evolution|enzyme|chromosome)\b", r"\b(?:metabol|genetic|ecology|bacteria|virus|species)\b"),
    "engineering": (r"\b(?:circuit|structural|mechanical|load\s*bearing|tolerance|specification)\b", r"\b(?:prototype|fabrication|manufacturing|hvac|aerospace)\b"),
}


def needles(pattern: str) -> list[str]:
    """Plain lower-case pieces of which every match of the pattern has one: the longest of each of its alternatives."""
    bare = re.sub(r"\(\?i\)|\\b", "", pattern)
    inner = re.fullmatch(r"\(\?:(.*)\)", bare)
    alternatives = re.split(r"\|(?![^(]*\))", inner[1] if inner and "(" not in re.sub(r"\(\?:[a-z]*\)", "", inner[1]) else bare)
    pieces = lambda a: re.findall(r"[a-z]+", re.sub(r"\(\?:[^)]*\)\??|\[[^\]]*\][*+?]?|\\[a-z][*+?]?|.\?", " ", re.sub(r"[A-Z]", lambda c: c[0].lower(), a)))
    inside = lambda a: re.search(r"\(\?:([^)]*)\)", a)[1].split("|")  # noqa: E731  of a pattern whose plain pieces are all in one group
    return sorted({max(pieces(b), key=len) for a in alternatives for b in ([a] if pieces(a) else inside(a))})


def may_match(lower: Column, pattern: str) -> Column:
    """Whether a lower-cased text has any of the pattern's needles; a look for plain pieces costs a fraction of a pattern's."""
    return reduce(Column.__or__, (F.contains(lower, F.lit(x)) for x in needles(pattern)))


def found_in(text: Column, lower: Column, pattern: str) -> Column:
    """``rlike`` behind the look for needles."""
    return F.when(may_match(lower, pattern), text.rlike(pattern)).otherwise(False)


def plain_words(pattern: str) -> list[str]:
    """Of a pattern of the kind \\b(?:one|other)\\b: the alternatives that are words as they stand."""
    inner = re.fullmatch(r"\\b\(\?:(.*)\)\\b", pattern)
    return [a for a in re.split(r"\|(?![^(]*\))", inner[1]) if re.fullmatch("[a-z]+", a)] if inner else []


def content_domain(text: Column, filename: Column, characters: int = 10_000) -> Column:
    """The domain with most matches in the first ``characters``, two at least; paper-like names add two to any that has some.

    The sample is cut into words once, and those that any pattern knows are picked out by one look each; a pattern runs
    only where one of its words was picked, or a piece of its other alternatives occurs."""
    paper = F.lower(filename).rlike("paper|arxiv|proceedings")
    known = {p: plain_words(p) for ps in DOMAINS.values() for p in ps}
    others = {p: [n for n in needles(p) if n not in known[p]] for p in known}
    every = sorted({w for words in known.values() for w in words})

    def hits(sample: Column) -> Column:
        def of_words(picked: Column) -> Column:
            def count(p: str) -> Column:
                some = [F.arrays_overlap(picked, literals(known[p]))] if known[p] else []
                return F.when(reduce(Column.__or__, [*some, *(F.contains(sample, F.lit(n)) for n in others[p])]), F.regexp_count(sample, F.lit(p))).otherwise(0)

            return F.array(*(reduce(Column.__add__, (count(p) for p in ps)) for ps in DOMAINS.values()))

        return let(F.array_distinct(F.filter(F.split(sample, "[^a-z0-9_]+"), lambda w: w.isin(*every))), of_words)

    best = lambda s: F.when(F.array_max(s) >= 2, F.element_at(literals(DOMAINS), F.array_position(s, F.array_max(s)).cast("int"))).otherwise("general")
    # each pattern runs once a row: counts are bound before they are compared
    return let(F.substring(F.lower(text), 1, characters), lambda sample: let(F.transform(hits(sample), lambda h: F.when((h > 0) & paper, h + 2).otherwise(h)), best))


#: Signs of the kinds of long documents.
BOOK_SIGNS = (r"(?i)\bchapter\s+[0-9]", r"(?i)\blesson\s+[0-9]", r"(?i)\bpart\s+(?:one|two|three|four|five|[IVX]+|[0-9])", r"(?i)\bforeword\b", r"(?i)\bpreface\b", r"(?i)\btable\s+of\s+contents\b", r"(?i)\babout\s+the\s+author\b", r"(?i)\bdedication\b", r"(?i)\backnowledgments?\b")
TEXTBOOK_SIGNS = (r"(?i)\breview\s+questions?\b", r"(?i)\bexercises?\b", r"(?i)\blearning\s+objectives?\b", r"(?i)\bkey\s+terms?\b", r"(?i)\bchapter\s+summary\b", r"(?i)\bfurther\s+reading\b", r"(?i)\bcase\s+study\s+[0-9]", r"(?i)\bfigure\s+[0-9]", r"(?i)\btable\s+[0-9]+\.[0-9]")
NARRATIVE_SIGNS = (r"\bI\s+(?:was|had|remember|recall|grew|lived|went|came|saw|felt|thought|knew|wanted|needed)\b", r"(?i)\bmy\s+(?:mother|father|family|childhood|life|home|school|friend)\b", r"\bwe\s+(?:were|had|lived|grew|went|came)\b", r"(?i)\bwhen\s+I\s+was\s+(?:young|a\s+child|growing|born)\b", r"\bshe\s+said\b", r"\bhe\s+told\s+me\b", r"\bI\s+remember\b", r"\bthose\s+were\s+the\s+days\b")


def field_type(text: Column, filename: Column, characters: int = 8000, told_in: int = 15_000) -> Column:
    """code, documentation, notes, research-paper, textbook, book, report or other; kinds of long documents by their first ``characters`` and, for telling, ``told_in``."""
    name = F.lower(filename)
    headed = text.rlike(r"(?m)^#\s+")

    def found(both: Column) -> Column:
        whole, lower = both["whole"], both["lower"]
        has = lambda p: found_in(lower, lower, p)
        count = lambda t, signs: reduce(Column.__add__, (found_in(t, whole, s).cast("int") for s in signs))
        references = has(r"\b(?:references|bibliography)\b")
        paper = name.rlike(r"[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?|arxiv") | (references & (has(r"\b(?:introduction|method|methods|methodology|results|discussion|conclusion)\b") | has(r"\babstract\b")))
        return F.struct(paper.alias("paper"), has(r"\b(?:chapter|unit)\s+[0-9]").alias("unit"), word_count(text).alias("words"), count(text, BOOK_SIGNS).alias("book"), count(text, TEXTBOOK_SIGNS).alias("textbook"), count(F.substring(text, 1, told_in), NARRATIVE_SIGNS).alias("told"))

    def kind(c: Column) -> Column:
        telling = (c["told"] >= 3) | ((c["told"] >= 2) & (c["book"] >= 2))
        return F.when(c["paper"], "research-paper").when(c["textbook"] >= 3, "textbook").when(telling | (c["book"] >= 2) | ((c["book"] >= 1) & (c["words"] > 10_000)), "book").when(c["unit"] & (c["textbook"] >= 1), "textbook").when(c["unit"] | (c["words"] > 20_000), "book").otherwise("report")

    long = let(F.lower(text), lambda whole: let(F.struct(whole.alias("whole"), F.substring(whole, 1, characters).alias("lower")), lambda both: let(found(both), kind)))
    return F.when(name.rlike(r"\.(py|ts|js|java|go|rs|cpp|c|rb|php|swift|kt|scala|sh|bash)$"), "code").when(name.rlike(r"\.(md|markdown)$"), F.when(headed, "documentation").otherwise("notes")).when(name.rlike(r"\.txt$"), F.when(headed, "notes").otherwise("other")).when(name.rlike(r"\.(pdf|docx)$"), long).otherwise("other")
