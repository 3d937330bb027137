"""Host and path rules and listed urls: a blocked Bloom filter, then an exact hash join.

Everything here is DataFrame code. A url is turned into the keys that a rule or a
listed url could have: each suffix of its host with each prefix of its path that
is as long as some rule's path, and its canonical form. The Bloom filter is kept as a few
long arrays, so that a probe reads one word of one of them where the row is; only keys that may be listed are joined with the
list itself, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemodex.llm.common import cut

#: Bits of a filter block: one 64-bit word, so a probe reads a single word. Words of a segment, a row of the filter.
BLOCK_BITS, SEGMENT = 64, 1 << 16
#: The filter has so many segments at most (32 MB). Beyond ``BITS_PER_KEY`` for each key it gets denser, and
#: with fewer than ``LEAST_BITS`` it would let too much through: then keys go to the join as they are.
MOST_SEGMENTS, BITS_PER_KEY, LEAST_BITS = 64, 16, 4
PROBES = 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; path: then up to ``?``, ``#`` or end.

    Null urls and urls without ``://`` have an empty host and path.
    """
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _escapes(text: Column) -> Column:
    """Percent escapes in one form: letters, digits and ``-._~`` as themselves, the others with upper-case digits."""

    def one(piece: Column) -> Column:
        code = F.upper(F.substring(piece, 1, 2))
        plain = F.char(F.conv(code, 16, 10).cast("int"))
        piece_rest = F.substring(piece, F.lit(3), F.length(piece))
        known = F.when(plain.rlike(r"^[A-Za-z0-9._~-]$"), F.concat(plain, piece_rest)).otherwise(F.concat(F.lit("%"), code, piece_rest))
        return F.when(piece.rlike(r"(?s)^[0-9A-Fa-f]{2}"), known).otherwise(F.concat(F.lit("%"), piece))

    pieces = F.split(text, "%")
    return F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), one), ""))


def canonical(url: Column) -> Column:
    """What tells urls apart: host, port, path and query, in one form; null if there is no ``://``.

    Scheme, user info, fragment, the ports 80 and 443 and dots at the host's end go, A-Z in the host is lower-cased, an
    empty path is ``/``, and percent escapes have one form.
    """
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"(?s)^([^#]*)", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^(?:[^/?]*@)?([^/?]*)", 1), _UPPER, _LOWER)
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"\.+(:[0-9]+)?$", "$1")
    tail = F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1)
    tail = F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))
    return F.when(at > 0, F.concat(host, _escapes(tail)))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def _bits(key: Column) -> Column:
    h, mask = F.xxhash64(key, F.lit(1)), F.lit(0).cast("long")
    for i in range(PROBES):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def blocked_bloom(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame | None, int]:
    """(segment, words) rows of a filter, at most ``MOST_SEGMENTS`` of them, and the number of its words; None if it would be too dense."""
    words = max(1, min(-(-n_keys * BITS_PER_KEY // BLOCK_BITS), MOST_SEGMENTS * SEGMENT))
    if words * BLOCK_BITS < LEAST_BITS * n_keys:
        return None, words
    filled = keys.select(_word(F.col(key), words).alias("word"), _bits(F.col(key)).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    filled = filled.groupBy(F.shiftright("word", 16).cast("int").alias("segment")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(SEGMENT - 1).cast("int"), "bits"))).alias("at"))
    place = F.sequence(F.lit(0), F.lit(min(words, SEGMENT) - 1))
    return filled.select("segment", F.transform(place, lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0).cast("long"))).alias("words")), words


def possible_hits(probes: DataFrame, listed: DataFrame, key: str, listed_key: str, n_listed: int) -> DataFrame:
    """The rows of ``probes`` whose ``key`` may be among ``listed_key``: all that are, and a few others."""
    bloom, words = blocked_bloom(listed, listed_key, n_listed)
    if bloom is None:
        return probes
    word = _word(F.col(key), words)
    placed = probes.withColumn("_segment", F.shiftright(word, 16).cast("int"))
    joined = placed.join(F.broadcast(bloom.toDF("_at", "_words")), F.col("_segment") == F.col("_at"))  # at most MOST_SEGMENTS rows of 512 KB
    found = F.element_at("_words", word.bitwiseAND(F.lit(SEGMENT - 1)).cast("int") + 1)
    return joined.filter(found.bitwiseAND(_bits(F.col(key))) == _bits(F.col(key))).select(*probes.columns)


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to ``pages``.

    ``rules`` has the columns host, path and verdict. A rule fits its host and all subdomains
    if the url's path starts with the rule's path; it is reported as host and path together. ``listed`` has the columns
    url and verdict; a listed url is hit by all urls of the same ``canonical`` form. A rule goes before a listed
    url, the longest host and path win, then the longer host. Of equal rules or listed urls the largest verdict counts; those with nulls are
    passed over. Urls that nothing fits get ``default``; so do null and malformed ones. Columns of ``pages`` with
    these four names are replaced, all others stay, whatever their names; no row is lost or repeated. Hosts may have any number of labels: work
    per url is one key for each pair of label count and path length that rules have.
    """
    out = ["host", "path", "rule", "verdict"]
    names = [c for c in pages.columns if c not in out or c == url]
    base = pages.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    at = f"c{names.index(url)}"
    host, path = host_and_path(F.col(at))
    given = rules.select(F.concat("host", F.lit("\n"), "path").alias("key"), F.col("verdict"), F.concat("host", "path").alias("rule"), F.length("host").alias("size"), F.struct(_labels(F.col("host")).alias("labels"), F.length("path").alias("start")).alias("reach"))
    if listed is not None:
        form = canonical(F.col("url"))
        given = given.unionByName(listed.select(form.alias("key"), "verdict", F.lit(None).cast("string").alias("rule"), F.lit(0).alias("size"), F.lit(None).cast("struct<labels:int,start:int>").alias("reach")))
    given = cut(given.filter("key is not null and verdict is not null").groupBy("key", "rule", "size", "reach").agg(F.max("verdict").alias("verdict")))
    # Only ends of a host with as many labels as some rule's host, and begins of a path as long as that rule's path, can be hit.
    n_given, reaches = given.agg(F.count(F.lit(1)), F.collect_set("reach")).first()
    judged = base.select(*base.columns, host.alias("host"), path.alias("path"))

    def named(df: DataFrame, rule: Column, verdict: Column) -> DataFrame:
        kept = [F.col(c).alias(n) for c, n in zip(base.columns, names) if n not in out]
        again = [F.col(at).alias(url)] if url in out else []
        return df.select(*kept, *again, *[F.col(c) for c in ("host", "path") if c != url], rule.alias("rule"), verdict.alias("verdict"))

    if not n_given:
        return named(judged, F.lit(None).cast("string"), F.lit(default))
    # Each different url is judged once, so a url that repeats a million times costs one row.
    seen = base.select(F.col(at).alias("u")).filter("u is not null").distinct()
    host, path = host_and_path(F.col("u"))
    seen = seen.select("u", host.alias("h"), path.alias("p"), _labels(host).alias("n"))
    fits = F.array(*[F.struct(F.lit(r.labels).alias("labels"), F.lit(r.start).alias("start")) for r in sorted(reaches)]) if reaches else F.array().cast("array<struct<labels:int,start:int>>")
    fits = F.filter(fits, lambda r: (r["labels"] <= F.col("n")) & (r["start"] <= F.length("p")))
    keys = F.transform(fits, lambda r: F.concat(F.call_function("substring_index", F.col("h"), F.lit("."), -r["labels"]), F.lit("\n"), F.substring(F.col("p"), F.lit(1), r["start"])))
    if listed is not None:
        keys = F.array_compact(F.concat(keys, F.array(canonical(F.col("u")))))
    probes = seen.select("u", F.explode(keys).alias("k"))
    hits = possible_hits(probes, given, "k", "key", n_given).join(given, F.col("k") == F.col("key"))
    order = F.struct(F.col("rule").isNotNull().alias("r"), F.length("rule").alias("n"), "size", "key")
    best = cut(hits.groupBy("u").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best")))
    # Rows with a null url need no join; ``best`` is a written table, so Spark can split a url that very many rows have.
    joined = judged.filter(F.col(at).isNotNull()).join(best, F.col(at) == F.col("u"), "left")
    none = judged.filter(F.col(at).isNull())
    return named(joined, F.col("best.rule"), F.coalesce("best.verdict", F.lit(default))).unionByName(named(none, F.lit(None).cast("string"), F.lit(default)))
