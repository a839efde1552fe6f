"""Text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
LANGUAGES = ["en", "fr", "de", "ja", "ko", "es", "ru", "ar", "pt", "it"]
JOURNAL_TAGS = {"cas": ["中科院一区", "中科院二区", "中科院三区", "中科院四区"], "jcr": ["Q1", "Q2", "Q3", "Q4"], "index": ["SCI", "SSCI", "EI", "Scopus", "CSCD", "北大核心", "CSSCI"]}
CONFERENCE_TAGS = {"ccf": ["CCF-A", "CCF-B", "CCF-C", "非CCF"], "core": ["CORE A*", "CORE A", "CORE B", "CORE C"], "index": ["EI", "SCI", "SSCI", "CPCI", "Scopus"]}
COMMON_ACRONYMS = ["PDF", "DOI", "URL", "HTTP", "DNA", "RNA", "ATP", "AI", "ML", "LLM", "USA", "UK", "WHO", "UN", "EU", "IEEE", "ACM"]
SUPERSCRIPT = ("0123456789+-.", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻·")
SUBSCRIPT = ("0123456789+-", "₀₁₂₃₄₅₆₇₈₉₊₋")
PHRASE_STOP_WORDS = ["the", "and", "for", "with", "from", "that", "this", "were", "are", "was", "into", "than", "then", "have", "has", "had", "using", "used", "between", "among", "paper", "study", "result", "results", "method", "methods", "analysis", "figure", "table", "section", "data"]
CHINESE = re.compile("[\u4e00-\u9fff]+")


def first_text(*columns: Column | str) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns], F.lit(""))


def word_score(text: Column, query: str) -> Column:
    """How many of the query's words, repeated ones repeatedly, are substrings of the text; both in lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("long") for w in query.lower().split()], F.lit(0).cast("long"))


def annotation_tokens(query: str) -> list[str]:
    """What an annotation is searched for: words between blanks, and of Chinese text each run and its neighbouring twos and threes; a query without anything of two characters stands for itself."""
    wanted = set(query.split())
    for run in CHINESE.findall(query):
        wanted.add(run)
        for width in (2, 3):
            wanted.update(map("".join, zip(*(run[k:] for k in range(width)))))
    return sorted(w for w in wanted if len(w) > 1) or [query]


def contains_any(text: Column, tokens: list[str]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in tokens], F.lit(False))


def relevant(text: Column, keywords: list[str]) -> Column:
    """Nothing without keywords; everything if none has two characters; else texts with any that has."""
    if not keywords:
        return F.lit(False)
    long = [k for k in keywords if len(k) >= 2]
    return contains_any(text, long) if long else F.lit(True)


def clip(text: Column, limit: int = 500) -> Column:
    """White space collapsed, cut at ``limit`` characters and back to the last blank, with '...'."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, limit), " [^ ]*$", ""), F.lit("...")))


def snippet(text: Column, query: str, before: int = 50, after: int = 200) -> Column:
    """From ``before`` characters ahead of the first match to ``after`` behind its start; without a match the first ``after``."""
    at = F.locate(query.lower(), F.lower(text))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at + after - start)).otherwise(F.substring(text, 1, after))


def without_reference_number(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*(?:\[\d+\]|\(\d+\)|\d+[.)]\s*)\s*", "")


def is_image_line(line: Column) -> Column:
    return F.startswith(line, F.lit("!["))


def image_url(line: Column) -> Column:
    """The address in ![alt](address), else the line."""
    return first_text(F.regexp_extract(line, r"!\[[^\]]*\]\(([^)]+)\)", 1), line)


def heading_level(line: Column) -> Column:
    """1 to 3 for lines that begin with so many # and a blank, else 0."""
    return F.length(F.regexp_extract(line, r"^(#{1,3})\s", 1))


def heading_text(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^#{1,3}\s+", ""))


def superscript(text: Column) -> Column:
    return F.translate(text, *SUPERSCRIPT)


def subscript(text: Column) -> Column:
    return F.translate(text, *SUBSCRIPT)


def masked(value: Column) -> Column:
    """The first four characters, the rest as asterisks."""
    return F.concat(F.substring(value, 1, 4), F.repeat(F.lit("*"), F.greatest(F.length(value) - 4, F.lit(0))))


def author_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, "[,;，；、]"), lambda x: F.trim(x)), lambda x: x != "")


def tag_list(value: Column) -> Column:
    return F.filter(F.split(value, "、"), lambda x: F.trim(x) != "")


def language(value: Column) -> Column:
    return F.when(F.lower(F.trim(value)).isin(LANGUAGES), F.lower(F.trim(value))).otherwise("en")


def valid_tags(tags: Column, conference: Column) -> Column:
    """Those tags that the vocabulary of journals, or of conferences, has."""
    known = lambda groups: F.array(*[F.lit(t) for t in dict.fromkeys(t for g in groups.values() for t in g)])
    return F.when(conference, F.filter(tags, lambda t: F.array_contains(known(CONFERENCE_TAGS), t))).otherwise(F.filter(tags, lambda t: F.array_contains(known(JOURNAL_TAGS), t)))


def author_label(authors: Column) -> Column:
    n = F.size(authors)
    return F.when(n == 1, authors[0]).when(n == 2, F.concat(authors[0], F.lit(" & "), authors[1])).when(n > 2, F.concat(authors[0], F.lit(" et al."))).otherwise("")


def session_title(message: Column) -> Column:
    return F.when(F.length(message) > 40, F.concat(F.substring(message, 1, 40), F.lit("…"))).otherwise(message)


def capped(message: Column, level: Column, most: int = 80) -> Column:
    """A log line: whole for errors, else its first characters."""
    return F.when(level.isin("ERROR", "CRITICAL"), message).otherwise(F.substring(message, 1, most))


def export_name(title: Column, mode: str) -> Column:
    return F.concat(F.regexp_replace(F.substring(title, 1, 30), r'[\\/:*?"<>|]', ""), F.lit(f"_{mode}.docx"))


def without_fence(text: Column) -> Column:
    """Without a code fence around it and one pair of quotes."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*\n?", ""), r"\n?```$", ""))
    return F.regexp_replace(bare, r"""^(["'])(.*)\1$""", "$2")


def citation_numbers(text: Column) -> Column:
    """The numbers in marks such as [1, 2], in order."""
    marks = F.regexp_extract_all(text, F.lit(r"\[(\d+(?:,\s*\d+)*)\]"), 1)
    return F.transform(F.flatten(F.transform(marks, lambda m: F.split(m, r",\s*"))), lambda n: n.cast("int"))


def separate_citations(text: Column) -> Column:
    """Marks of several numbers as one mark each, and no comma between neighbouring marks: '[1, 2], [3]' is '[1][2][3]'."""
    mark = r"\[\d+(?:,\s*\d+)*\]"
    joined = F.regexp_replace(text, rf"({mark})\s*,\s*(?={mark})", "$1")
    return F.regexp_replace(joined, r"(?<=[\[,]\s{0,9}\d{1,9}),\s*(?=\d+(?:,\s*\d+)*\])", "][")


def base_url(address: Column) -> Column:
    """An address without blanks and slashes at its end, and with http where it names no protocol; null without one."""
    bare = F.nullif(F.regexp_replace(F.trim(address), "/+$", ""), F.lit(""))
    return F.when(F.rlike(bare, F.lit("^https?://")), bare).otherwise(F.concat(F.lit("http://"), bare))


def is_loopback(url: Column) -> Column:
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return (host == "localhost") | F.rlike(host, F.lit(r"^127(\.\d{1,3}){3}$")) | (host == "[::1]")


def is_lan_address(ip: Column) -> Column:
    """An IPv4 address that another device can be reached at: none of loopback, link-local, multicast or unspecified."""
    part = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.rlike(ip, F.lit(rf"^{part}(\.{part}){{3}}$")) & ~F.rlike(ip, F.lit(r"^(127\.|169\.254\.|2(2[4-9]|3\d)\.|0\.0\.0\.0$)"))


def bundle_path(number: Column, path: Column) -> Column:
    """Where a bundle keeps a file: by its number, with its suffix if that is short and plain, else '.bin'."""
    suffix = F.regexp_extract(F.lower(path), r"[^/.][^/]*(\.[a-z0-9]{1,12})$", 1)
    return F.concat(F.lit("files/"), F.lpad(number.cast("string"), 6, "0"), F.coalesce(F.nullif(suffix, F.lit("")), F.lit(".bin")))


def stays_inside(path: Column) -> Column:
    """Whether a relative path stays below its root: at no point more parts up than down."""
    lowest = F.aggregate(F.split(path, "/+"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), _walk, lambda a: a["low"])
    return ~F.startswith(path, F.lit("/")) & (lowest >= 0)


def _walk(a: Column, x: Column) -> Column:
    at = a["d"] + F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1)
    return F.struct(at.alias("d"), F.least(a["low"], at).alias("low"))


def fenced_json(text: Column) -> Column:
    """What the first code fence holds, else the whole text, trimmed."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.trim(first_text(inner, text))


def formulas(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\$\$[\s\S]+?\$\$|\$[^$\n]+?\$)"), 1)


def block_number(block_id: Column) -> Column:
    """The digits of a block id as a number, 0 without any."""
    return F.coalesce(F.regexp_replace(block_id, r"\D+", "").try_cast("int"), F.lit(0))


def stage_progress(stage: str, done: Column, total: Column) -> Column:
    """Percent reached when ``done`` of ``total`` parts of a stage are through."""
    start, width = {"clean": (20, 30), "classify": (55, 5), "translate": (60, 30), "images": (91, 4)}[stage]
    return (F.lit(start) + F.floor(done / total * width)).cast("int")


def exclusive_tags(tags: Column, groups: dict[str, list[str]], none: str = "unclassified") -> Column:
    """Of tags in the order chosen: the last one of each exclusive group, all others once; ``none``, if chosen last, alone, else dropped."""
    of = F.create_map(*[F.lit(x) for g, names in groups.items() for n in names for x in (n, g)])
    last = lambda t, i: ~F.exists(F.slice(tags, i + 2, F.size(tags)), lambda u: (u == t) | (F.coalesce(of[u], u) == F.coalesce(of[t], t)))
    kept = F.filter(tags, lambda t, i: last(t, i) & (t != none))
    return F.when(F.element_at(tags, -1) == none, F.array(F.lit(none))).otherwise(kept)


def tool_calls(text: Column) -> Column:
    """Calls written out in a text as <invoke name="..."><parameter name="...">...</parameter></invoke>: array of (name, arguments map)."""
    names = F.regexp_extract_all(text, F.lit(r'(?s)<invoke name="([^"]+)">(.*?)</invoke>'), 1)
    bodies = F.regexp_extract_all(text, F.lit(r'(?s)<invoke name="([^"]+)">(.*?)</invoke>'), 2)
    pattern = F.lit(r'(?s)<parameter name="([^"]+)"[^>]*>(.*?)</parameter>')
    arguments = lambda b: F.map_from_arrays(F.regexp_extract_all(b, pattern, 1), F.regexp_extract_all(b, pattern, 2))
    return F.transform(F.arrays_zip(names.alias("name"), bodies.alias("body")), lambda x: F.struct(x["name"].alias("name"), arguments(x["body"]).alias("arguments")))


def clamped(progress: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), progress))
