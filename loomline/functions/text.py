"""Column functions on texts, paths and names."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a regular expression class, with the Unicode spaces that log texts hold.
SPACE = r"[\s 　 -   ﻿]"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
LONGEST_TOKEN = 40

# Words that carry no topic, in English and Japanese.
STOP_WORDS = tuple(
    """the a an is are was were be been being have has had do does did will would could should may might shall can need must
    ought i you he she it we they me him her us them my your his its our their mine yours hers ours theirs this that these
    those what which who whom whose when where why how all each every both few more most other some such no nor not only own
    same so than too very just because as until while of at by for with about against between through during before after
    above below to from up down in out on off over under again further then once here there and but or if else also like
    please thanks thank yes ok okay sure let make use using used want see look try get got think know now new way well back
    still file code change changes add update fix set
    の に は を が で と も か な だ です ます する した して ない ある いる これ それ あれ この その あの ここ そこ こと もの ため よう から
    まで より ほど など ので けど でも しかし また そして って という ください お願い 確認""".split()
)
STOPS = frozenset(STOP_WORDS)


def camel_parts(word: Column) -> Column:
    """A word cut at camel-case steps, in lower case."""
    spaced = F.regexp_replace(F.regexp_replace(word, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.transform(F.split(spaced, f"{SPACE}+"), F.lower)


def path_tokens(text: Column) -> Column:
    """Words of the path segments in a text: paths of two segments or more, extensions off, over two characters."""
    segments = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"(?:/[\w.-]+){2,}"), 0), lambda p: F.filter(F.split(p, "/"), lambda s: s != "")))
    names = F.filter(F.transform(segments, lambda s: F.regexp_replace(s, r"\.[^.]+$", "")), lambda s: F.length(s) > 2)
    return F.flatten(F.transform(names, camel_parts))


#: Words that a counting task remembers the terms of; all are forgotten when there are more.
KEPT = 1 << 18
_WORD = re.compile(r"[^`'\"{}()\[\]<>;:,!?@#$%^&*=+|\\~/" + SPACE[1:-1] + "]+", re.ASCII)
_PATH = re.compile(r"(?:/[\w.-]+){2,}", re.ASCII)
_UUID = re.compile(UUID, re.ASCII)
_PLAIN = re.compile("[A-Za-z]?[a-z0-9]*")  # most words need no cutting
_NO_TERM = re.compile(r"[0-9a-f]{6,}|[0-9]+")
_STEP, _LAST = re.compile("([a-z])([A-Z])"), re.compile("([A-Z]+)([A-Z][a-z])")
_ODD, _CUT = re.compile("[^a-z0-9぀-鿿 _-]"), re.compile("[-_ ]")


def _camel(word: str) -> str:
    return _LAST.sub(r"\1 \2", _STEP.sub(r"\1 \2", word)).lower()


def terms_of_word(word: str) -> list[str]:
    """The terms of a word between white space and signs: cut at hyphens, underscores and camel-case steps, in lower case,
    reduced to letters and digits, without stop words and noise; none of an address or a UUID."""
    if word.startswith("http") or (len(word) == 36 and _UUID.fullmatch(word)):
        return []
    if word.isalpha() and word.isascii() and word.islower():
        return [word] if 2 < len(word) <= LONGEST_TOKEN and word not in STOPS and not (len(word) > 5 and _NO_TERM.fullmatch(word)) else []
    parts = [word.lower()] if _PLAIN.fullmatch(word) else _CUT.split(_ODD.sub("", _camel(word)))
    return [x for x in parts if 2 < len(x) <= LONGEST_TOKEN and x not in STOPS and not _NO_TERM.fullmatch(x)]


def terms_of_paths(text: str) -> list[str]:
    """What path_tokens gives, of one text."""
    names = (re.sub(r"\.[^.]+$", "", s) for p in _PATH.findall(text) for s in p.split("/") if s)
    return [x for name in names if len(name) > 2 for x in _camel(name).split(" ")]


class Terms(dict):
    """The terms of the words met lately, by word."""

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= KEPT:
            self.clear()
        self[word] = terms = terms_of_word(word)
        return terms


def term_counter() -> Callable[[str], dict[str, int]]:
    """A function that counts the terms of a text and remembers those of the words it has met."""
    known = Terms()

    def count(text: str) -> dict[str, int]:
        found = Counter(chain.from_iterable(map(known.__getitem__, _WORD.findall(text))))
        if "/" in text:
            found.update(terms_of_paths(text))
        return found

    return count


def cut(text: Column, most: int, mark: str = "…") -> Column:
    """The text's first characters, with a mark where more follow."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def project_of_directory(name: Column) -> Column:
    """org/repo of a dash-joined directory name: what follows github-com, else the last two parts, else the name."""
    parts = F.filter(F.split(name, "-"), lambda p: p != "")
    n, at = F.size(parts), F.array_position(parts, "github").cast("int")
    hosted = (at > 0) & (F.try_element_at(parts, at + 1) == "com") & (n > at + 2)
    after = F.array_join(F.slice(parts, F.greatest(at + 2, F.lit(1)), F.greatest(n, F.lit(1))), "/")
    return F.when(n < 2, name).when(F.coalesce(hosted, F.lit(False)), after).otherwise(F.array_join(F.slice(parts, F.when(n >= 2, F.lit(-2)).otherwise(F.lit(1)), 2), "/"))


def project_of_cwd(cwd: Column) -> Column:
    """The last two segments of a working directory, null with fewer."""
    parts = F.filter(F.split(cwd, "/"), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, F.when(F.size(parts) >= 2, F.lit(-2)).otherwise(F.lit(1)), 2), "/"))


def common_prefix(paths: Column, directories: bool = True) -> Column:
    """The path that an array of paths shares.

    With directories, a single path gives its directory and a last segment with a dot goes; without, a prefix of one
    segment is too general and gives the empty string. The least and greatest of the arrays of segments share exactly the
    prefix that all share.
    """
    parts = F.transform(paths, lambda p: F.split(p, "/"))
    low, high = F.array_min(parts), F.array_max(parts)
    same = F.zip_with(low, high, lambda a, b: a.eqNullSafe(b) & a.isNotNull())
    n = F.coalesce(F.array_position(same, False).cast("int") - 1, F.lit(0))
    n = F.when(n < 0, F.size(same)).otherwise(n)
    shared = F.slice(low, 1, n)
    if not directories:
        return F.when(n <= 1, "").otherwise(F.coalesce(F.array_join(shared, "/"), F.lit("")))
    trimmed = F.when((n > 0) & F.contains(F.try_element_at(low, F.greatest(n, F.lit(1))), F.lit(".")), F.slice(shared, 1, F.greatest(n - 1, F.lit(0)))).otherwise(shared)
    single = F.array_join(F.slice(low, 1, F.greatest(F.size(low) - 1, F.lit(0))), "/")
    joined = F.when(F.size(paths) == 0, "").when(F.size(paths) == 1, single).otherwise(F.array_join(trimmed, "/"))
    return F.when(joined == "/", "").otherwise(F.coalesce(joined, F.lit("")))


def date_text(ts: Column) -> Column:
    """Month, day and year."""
    return F.date_format(ts, "MMM d, yyyy")


def date_time_text(ts: Column) -> Column:
    """Month, day and year with the time of day in twelve hours."""
    return F.date_format(ts, "MMM dd, yyyy, hh:mm a")


def time_text(ts: Column) -> Column:
    """The time of day to the second."""
    return F.date_format(ts, "HH:mm:ss")


def scalar_inputs(raw: Column, most: int = 5) -> Column:
    """A JSON object's first keys, in its order, whose values are neither null nor objects or arrays, with the values as
    text; an empty array for anything else."""
    value = F.try_parse_json(raw)
    pairs = F.transform(F.json_object_keys(raw), lambda k: F.struct(k.alias("key"), F.element_at(F.from_json(raw, "map<string,string>"), k).alias("value")))
    plain = F.filter(pairs, lambda p: p["value"].isNotNull() & ~p["value"].rlike(r"(?s)^\s*[\[{]"))
    return F.when(value.isNotNull(), F.slice(F.coalesce(plain, F.array().cast("array<struct<key:string,value:string>>")), 1, most)).otherwise(F.array().cast("array<struct<key:string,value:string>>"))


def duration_text(minutes: Column) -> Column:
    """1h 5m, or 5m below an hour."""
    hours = F.floor(minutes / 60)
    return F.when(minutes >= 60, F.format_string("%dh %dm", hours, minutes - hours * 60)).otherwise(F.format_string("%dm", minutes))


def skill_name(keywords: Column, project: Column) -> Column:
    """Three keywords and the project's last segment, in lower case, hyphenated, of at most 40 characters."""
    plain = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    own = F.filter(F.transform(F.slice(keywords, 1, 3), plain), lambda x: x != "")
    tail = plain(F.element_at(F.split(project, "/"), -1))
    added = F.when((tail != "") & ~F.array_contains(own, tail), F.concat(own, F.array(tail))).otherwise(own)
    return F.left(F.array_join(added, "-"), F.lit(40))


def strip_preamble(markdown: Column) -> Column:
    """The text from its first line that begins with three dashes; unchanged without one."""
    found = F.regexp_extract(markdown, r"(?s)(?:^|\n)(---.*)$", 1)
    return F.when(markdown.startswith("---") | (found == ""), markdown).otherwise(found)


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounded as floor(x + 0.5) at that many digits."""
    return F.floor(value * 10**digits + 0.5) / float(10**digits)
