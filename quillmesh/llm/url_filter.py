"""URL filter: rules by host and path, else strict and soft terms of a vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm.common import free_names, map_arrow, query, table, task_cache

#: Points that block, from at least ``SOFT_TERMS`` distinct soft terms; one strict term
#: is enough by itself.
SOFT_LIMIT = 4
SOFT_TERMS = 2
#: Terms that block alone.
STRICT = (
    "porn", "porno", "xxx", "hentai", "escort", "escorts", "camgirls", "milf", "nsfw",
    "viagra", "cialis", "warez", "sexcam", "sexchat",
)
#: Soft terms by points: 3 for those that plain pages rarely have in an address, 2 for
#: those they sometimes have, 1 for everyday words that only strengthen another.
SOFT = {
    3: (
        "adult", "adults", "sex", "sexy", "nude", "nudes", "erotic", "fetish", "casino", "casinos",
        "poker", "roulette", "bet", "bets", "betting", "gambling", "slots", "jackpot", "payday",
        "pill", "pills", "keygen", "torrent", "torrents", "spam", "clickbait", "replica", "replicas",
    ),
    2: (
        "ad", "ads", "adserver", "banner", "banners", "popup", "popups", "popunder", "track", "tracker",
        "tracking", "naked", "cam", "cams", "webcam", "dating", "hookup", "singles", "loan", "loans",
        "lottery", "lotto", "pharmacy", "rx", "crack", "cracked", "serials", "followers", "seo",
    ),
    1: (
        "x", "hot", "free", "cheap", "win", "wins", "winner", "bonus", "click", "clicks", "farm", "farms",
        "girls", "live", "online", "cash", "credit", "instant", "deal", "deals", "offer", "offers",
        "discount", "bonuses", "spin", "spins", "vip",
    ),
}
#: (verdict, host, path): the rules of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return ascii_lower(host), path


def plain_url(url: str) -> str:
    """The URL with its escaped ASCII characters as they are, A-Z lower-cased; an escaped
    byte of any other character becomes a blank, which ends a word as that character does."""
    text = re.sub(r"%[89A-Fa-f][0-9A-Fa-f]", " ", url)
    return ascii_lower(re.sub(r"%([0-7][0-9A-Fa-f])", lambda m: chr(int(m[1], 16)), text))


def ascii_lower(s: str) -> str:
    return s.lower() if s.isascii() else re.sub("[A-Z]+", lambda m: m.group().lower(), s)


class Rules:
    """Longest rule for a host and path; the host's suffixes are looked up, not the rules."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))
        for own in self.by_host.values():
            own.sort(key=lambda x: -len(x[0]))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest host + path; the longer host on a tie."""
        best, suffix = None, host
        while suffix:
            for start, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start):
                    if best is None or len(suffix) + len(start) > len(best[0]):
                        best = (suffix + start, verdict)
                    break
            suffix = suffix.partition(".")[2]
        return best


class Vocabulary:
    """Hits of terms by one Aho-Corasick pass over the plain URL.

    ``soft`` has the terms of each number of points; a term of several has the most.
    """

    def __init__(self, strict: Sequence[str], soft: Mapping[int, Sequence[str]]):
        self.points = {w.lower(): n for n in sorted(soft) for w in soft[n]}
        self.strict = {w.lower() for w in strict}
        self.automaton = ahocorasick.Automaton()
        for word in self.strict | self.points.keys():
            self.automaton.add_word(word, word)
        self.automaton.make_automaton()

    def hits(self, url: str) -> tuple[int, int, int]:
        """Strict hits, distinct soft terms and their points; a term stands between
        characters other than ASCII letters and digits, or the ends."""
        text, strict, soft = plain_url(url), 0, set()
        if len(self.automaton) == 0:
            return 0, 0, 0
        for end, word in self.automaton.iter(text):
            before, after = end - len(word), end + 1
            if before >= 0 and _inner(text[before]) or after < len(text) and _inner(text[after]):
                continue
            if word in self.strict:
                strict += 1
            else:
                soft.add(word)
        return strict, len(soft), sum(self.points[w] for w in soft)


def _inner(c: str) -> bool:
    return c.isascii() and c.isalnum()


def filter_urls(
    df: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Mapping[int, Sequence[str]] = SOFT,
    soft_limit: int = SOFT_LIMIT,
    soft_terms: int = SOFT_TERMS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``keep`` columns, host, path, rule, strict_hits, soft_hits, soft_points and verdict
    per row.

    Without a rule, a URL is blocked by one strict term, or by ``soft_terms`` distinct
    soft ones with ``soft_limit`` points. A null URL, or one without ``://``, has an empty
    host and path and no rule; a null URL has no hits and is allowed. Rows are
    independent: nothing is shuffled, repeated rows stay, and only ``url`` and ``keep``
    are read. A result whose name ``keep`` has already gets underscores added.
    """
    rules, strict = tuple(rules), tuple(strict)
    terms = tuple((n, tuple(soft[n])) for n in sorted(soft))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    inner = [f"c{i}" for i in range(len(keep))]
    sorts = ["string"] * 3 + ["bigint"] * 3 + ["string"]
    schema = ", ".join([*(f"{n} {kinds[c]}" for n, c in zip(inner, keep)), *(f"r{i} {k}" for i, k in enumerate(sorts))])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, words = task_cache(
            f"url:{hash((rules, strict, terms))}", lambda: (Rules(rules), Vocabulary(strict, dict(terms)))
        )
        for batch in batches:
            cols: list[list] = [[] for _ in sorts]
            for value in batch.column("_url").to_pylist():
                host, path = split_url(value)
                found = table_.find(host, path)
                n, own, points = words.hits(value) if value is not None else (0, 0, 0)
                if found:
                    name, verdict = found
                else:
                    bad = n or own >= soft_terms and points >= soft_limit
                    name, verdict = None, "block" if bad else "allow"
                for c, v in zip(cols, (host, path, name, n, own, points, verdict)):
                    c.append(v)
            kinds_ = [pa.int64() if k == "bigint" else pa.string() for k in sorts]
            out = [batch.column(c) for c in inner] + [pa.array(c, k) for c, k in zip(cols, kinds_)]
            yield pa.RecordBatch.from_arrays(out, [*inner, *(f"r{i}" for i in range(len(sorts)))])

    front = [df[c].alias(n) for n, c in zip(inner, keep)]
    out = map_arrow(df.select(*front, df[url].alias("_url")), judge, schema)
    results = ["host", "path", "rule", "strict_hits", "soft_hits", "soft_points", "verdict"]
    return out.toDF(*keep, *free_names(keep, results))


def _oracle() -> str:
    """The query in SQL: split by patterns, rules by CASE, terms by one pattern each."""

    def at(word: str) -> str:
        return f"regexp_matches(u, '(^|[^a-z0-9]){word}($|[^a-z0-9])')"

    rules = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
        for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES)
    soft = " + ".join(f"CAST({at(w)} AS INT)" for n in SOFT for w in SOFT[n])
    points = " + ".join(f"{n} * CAST({at(w)} AS INT)" for n in SOFT for w in SOFT[n])
    plain = "url_decode(regexp_replace(url, '%[89A-Fa-f][0-9A-Fa-f]', ' ', 'g'))"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH parts AS (
      SELECT page_id, coalesce({lower.format(plain)}, '') AS u,
             CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
    hosts AS (SELECT page_id, u, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM parts),
    split AS (
      SELECT page_id, u, {lower.format("raw")} AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
    ruled AS (SELECT *, CASE {rules} END AS rule FROM split)
    SELECT page_id, host, path, rule,
           CASE rule {verdicts} ELSE
             CASE WHEN {" OR ".join(at(w) for w in STRICT)} 
               OR ({soft} >= {SOFT_TERMS} AND {points} >= {SOFT_LIMIT})
             THEN 'block' ELSE 'allow' END END AS verdict
    FROM ruled"""


@query("op7_url_filter", _oracle())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    out = filter_urls(table(spark, sf_dir, "pages"), keep=["page_id"])
    return out.select("page_id", "host", "path", "rule", "verdict")
