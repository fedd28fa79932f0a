r"""Operator 10: personal data by candidate gradient boosting.

Base spans come from four patterns with their checks. Broader generators then propose candidates, which overlap base spans and
each other: anything with an @ in its middle, addresses that spell out "(at)", any run of digit groups, runs of the
characters that keys are made of (a fifth kind, secret, which has no base). Where base spans are cut off, each run of
neighbouring digit groups with at most 19 digits that could be of some kind by its digits is a candidate, too. A candidate has
small integers as features: its format (digits, groups, separators, checksum, shares of classes) and its context (characters
around it, a telling word before it).

Boosted regression trees, one set for each kind, learn from the candidates of the whole table. Their labels come from checks
that they don't see: of the four kinds, that a candidate holds a checked base span, while the trait that the base pattern
demands by itself (the plus of a phone number, ASCII letters in an address) is no feature, so that candidates without it but
with all else alike score high; of secrets, a name like "token =" before them or a published prefix, while only form and
quotes are features. Candidates of which neither is known (digits or domain are valid, but no base span is held; letters
and digits are mixed, but no name tells) have no label: they may be what is sought. The threshold of a kind is the lowest
score from which on the lower end of the confidence interval (80 %) of the labelled candidates' precision is at least
``precision``, and of each single score at least half of all whole candidates are positive, so that those without a label are
never the most of it; a kind without such a score adds nothing. Candidates that reach it and touch no base span are added; of those
that overlap, addresses and secrets come first, then runs of groups, then undivided numbers, each by kind, score, size and place. That
compares the passing candidates of one cluster (in redaction, of one text) with the chosen ones, pair by pair.

Native: patterns give gaps and matches (split and regexp_extract_all), running sums of their lengths give positions, the
trees are CASE expressions. Trees are fitted on counts of distinct feature vectors, at most ``vectors`` of the most
frequent; thresholds are chosen from all candidates of the table, counted in Spark by hundredths of the score. Only
these vectors and counts reach the driver.

The patterns are written for a backtracking matcher: possessive loops run without recursion, and a match can begin only
where a run of its first class begins or the last match ended, so that long runs cost linear time.

Edge cases: a null text counts as empty; texts without digit, @ and (at) have no span; positions count code points; repeated
rows and ids are judged each; an empty table, or one without any base span, adds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
#: Kinds that spans may have; secrets (keys, tokens, passwords) have no base pattern.
KINDS = (*BASE, "secret")
NUMBERS = BASE[1:]

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates: something on both sides of an @, and digit groups with up to two separators between them.
ADDRESS = r"(?:(?<![^\x20\x09-\x0D@,;:<>()\[\]\x22])|\G)[^\x20\x09-\x0D@,;:<>()\[\]\x22]++@[^\x20\x09-\x0D@,;:<>()\[\]\x22]++"
NUMBER = r"[+(]?[0-9](?:[\x20().:/-]{0,2}+[0-9])++"
#: Addresses that are spelled out, and what stands there for @ and the full stop.
SPELLED_AT, SPELLED_DOT = (rf"\x20?[\[({{]\x20?(?i:{w})\x20?[\])}}]\x20?" for w in ("at", "dot"))
SPELLED = rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++{SPELLED_AT}[A-Za-z0-9-]++(?:(?:{SPELLED_DOT}|\.)[A-Za-z0-9-]++)++"
#: Runs of characters that keys are made of.
TOKEN = r"(?:(?<![A-Za-z0-9_+/-])|\G)[A-Za-z0-9_+/-]{10,}+={0,2}+"
#: A digit group with what may open a number before it, and what may stand between two groups of a run.
GROUP = r"[+(]?[0-9]++"
BETWEEN = r"^[\x20().:/-]{0,2}$"
RUN_DIGITS = 19
_MASK = "\ufffc"
_NAME = r"\[(?:EMAIL|IP|CARD|PHONE|SECRET)\]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_TELLING = {1: "tel|phone|fon|fax|call|mobil|llam", 2: "card|visa|carte|tarjeta|karte|iban", 3: r"\bip|host|addr|server", 4: "mail|contact|kontakt|correo"}
#: What tells a secret without a look at its form: a name and an assignment before it, or a published prefix. Never a feature.
_NAMED_SECRET = r"(?:key|token|secret|passw(?:or)?d|passphrase|pwd|auth|bearer|credential)[a-z0-9_-]{0,12}[\x22']?\s{0,2}[:=]\s{0,2}[\x22']?$"
_PREFIXED_SECRET = r"^(?:AKIA[A-Z0-9]{16}$|ASIA[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{20}|sk-[A-Za-z0-9]{16}|sk_live_|xox[abprs]-|AIza[A-Za-z0-9_-]{30}|eyJ[A-Za-z0-9_-]{16})"


@dataclass(frozen=True)
class Settings:
    rounds: int = 12
    depth: int = 3
    rate: float = 0.4
    #: What the lower end of the confidence interval of a score's precision must reach, and that interval's z (80 %, one-sided).
    precision: float = 0.9
    z: float = 0.84
    #: The most distinct feature vectors that trees are fitted on; thresholds see all.
    vectors: int = 20_000


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check. Twice a digit, less 9 above 9, is d * 2 % 9, but 9 for 9."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d == 9, 9).otherwise(d * 2 % 9)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """The check of a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    number = digits(match)
    if kind == "card":
        return F.when(F.length(number).between(14, 19), luhn(number)).otherwise(False)
    return F.length(number).between(10, 15)


def _split(text: Column, pattern: str) -> tuple[Column, Column]:
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


FEATURES = (
    "address", "digits", "groups", "last", "before_last", "dot", "dash", "space", "paren", "slash", "plus", "luhn", "octets", "before", "after", "telling", "tld", "dots", "odd",
    "length", "upper", "lower", "numerals", "turns", "marks", "hex", "quoted", "assigned",
)
#: What a kind's model must not see: the trait that its base pattern demands.
HIDDEN = {"email": {"odd"}, "ip": set(), "card": set(), "phone": {"plus", "digits"}, "secret": {"telling", "luhn", "octets"}}
#: The feature "address" of what the generators propose: 0 numbers, 1 addresses, 2 tokens.
KIND_OF = {4: 1, 5: 0, 6: 0, 7: 1, 8: 2}
GENERATORS = {4: ADDRESS, 5: NUMBER, 7: SPELLED, 8: TOKEN}
#: The kinds that a candidate of each sort can be.
KINDS_OF = {0: NUMBERS, 1: ("email",), 2: ("secret",)}


def _side(c: Column) -> Column:
    """A character beside a candidate: 0 none, 1 white space, 2 letter, 3 digit, 4 other."""
    return F.when(c == "", 0).when(c.rlike(r"^[\x20\x09-\x0D]"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[0-9]"), 3).otherwise(4)


def plain_address(match: Column) -> Column:
    """An address with @ and full stops where it spells them out."""
    return F.regexp_replace(F.regexp_replace(match, SPELLED_AT, "@"), SPELLED_DOT, ".")


def features(match: Column, gap: Column, after: Column, sort: int) -> Column:
    """The features of a candidate as an array of small integers; gap and after are the texts around it; sort: see KIND_OF."""
    address, token = sort == 1, sort == 2
    of = lambda pattern: F.length(F.regexp_replace(match, pattern, ""))
    eighths = lambda pattern: F.ceil(8 * of(pattern) / F.length(match)).cast("int") if token else F.lit(0)
    number = digits(match)
    n = F.length(number)
    runs = F.filter(F.split(match, "[^0-9]+"), lambda x: x != "")
    # spans that are masked or redacted already tell nothing
    near = F.lower(F.right(F.regexp_replace(F.right(gap, F.lit(64)), f"{_MASK}+|{_NAME}", ""), F.lit(24)))
    telling = F.lit(0)
    for code, words in _TELLING.items():
        telling = F.when(near.rlike(words), code).otherwise(telling)
    has = lambda x: F.contains(match, F.lit(x)).cast("int")
    length_at = lambda k: F.least(F.coalesce(F.length(F.try_element_at(runs, F.lit(k))), F.lit(0)), F.lit(7))
    domain = F.substring_index(match, "@", -1)
    values = {
        "address": F.lit(sort), "digits": F.least(n, F.lit(20)), "groups": F.least(F.size(runs), F.lit(6)), "last": length_at(-1), "before_last": length_at(-2),
        "dot": has("."), "dash": has("-"), "space": has(" "), "paren": has("("), "slash": F.greatest(has("/"), has(":")), "plus": F.startswith(match, F.lit("+")).cast("int"),
        "luhn": F.when(n.between(14, 19), luhn(number).cast("int")).otherwise(0) if sort == 0 else F.lit(0),
        "octets": match.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$").cast("int") if sort == 0 else F.lit(0),
        "before": _side(F.right(gap, F.lit(1))), "after": _side(F.left(after, F.lit(1))), "telling": telling,
        "tld": F.least(F.length(F.substring_index(domain, ".", -1)), F.lit(8)) if address else F.lit(0),
        "dots": F.least(F.size(F.split(domain, r"\.")) - 1, F.lit(4)) if address else F.lit(0),
        "odd": match.rlike(r"[^A-Za-z0-9._%+@-]").cast("int") if address else F.lit(0),
        "length": F.least(F.length(match) / 4, F.lit(16)) if token else F.lit(0), "upper": eighths("[^A-Z]"), "lower": eighths("[^a-z]"), "numerals": eighths("[^0-9]"),
        "turns": F.least(F.size(F.split(match, "[0-9]+")), F.lit(9)) if token else F.lit(0), "marks": F.least(of("[A-Za-z0-9]"), F.lit(4)) if token else F.lit(0),
        "hex": match.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("int") if token else F.lit(0), "quoted": gap.rlike(r"[\x22'\x60]$").cast("int") if token else F.lit(0),
        "assigned": gap.rlike(r"[:=]\s?[\x22'\x60]?$").cast("int") if token else F.lit(0),
    }
    return F.array(*[F.coalesce(values[k].cast("int"), F.lit(0)) for k in FEATURES])


def _holds(kind: str, match: Column) -> Column:
    """Whether a candidate holds a checked base match: the label."""
    return F.exists(F.regexp_extract_all(match, F.lit(PATTERNS[kind]), F.lit(0)), lambda m: passes(kind, m))


#: What a candidate without a label has in its place: a whole one, and a part of a number, which overlaps others.
OPEN, OPEN_PART = -1, -2


def _labels(match: Column, gap: Column | None, sort: int, part: bool = False) -> Column:
    """1 for candidates that hold a checked base match of a kind, 0 for those that can't be of it, else OPEN. Of secrets, which
    have no base: 1 for those with a telling name or prefix, 0 for those without digits or without letters."""
    if sort == 2:
        told = F.lower(F.right(gap, F.lit(40))).rlike(_NAMED_SECRET) | match.rlike(_PREFIXED_SECRET)
        mixed = match.rlike("[0-9]") & match.rlike("[A-Za-z]")
        return F.array(*[F.lit(0)] * len(BASE), F.when(~mixed, 0).when(told, 1).otherwise(OPEN))
    valid = {"email": valid_domain(match)} if sort == 1 else {k: could_be(k, match) for k in NUMBERS}
    if sort == 0:
        # what holds a base match of another kind is none
        valid["phone"] = valid["phone"] & ~_holds("card", match) & ~_holds("ip", match)
    open_ = OPEN_PART if part else OPEN
    return F.array(*[F.when(_holds(k, match), 1).when(valid[k], open_).otherwise(0) if k in valid else F.lit(0) for k in KINDS])


def valid_domain(match: Column) -> Column:
    """Whether a candidate ends in a domain of letters and digits of any script, full stops after it aside."""
    domain = F.regexp_replace(F.substring_index(match, "@", -1), r"[.!?]++$", "")
    top = F.substring_index(domain, ".", -1)
    return domain.rlike(r"^[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}.-]*+$") & domain.contains(".") & ~domain.contains("..") & top.rlike(r"^[\p{L}\p{M}]{2,}+$")


def could_be(kind: str, match: Column) -> Column:
    """Whether the digits of a whole candidate are valid for a kind, whatever stands between or before them."""
    if kind == "ip":
        return passes(kind, match)
    n = F.length(digits(match))
    return n.between(10, 15) if kind == "phone" else F.when(n.between(14, 19), luhn(digits(match))).otherwise(False)


def grouped(df: DataFrame, text: Column) -> DataFrame:
    """df with the digit groups of a text as __m, the gaps around them as __g, both in turn as __p, the groups' numbers of
    digits as __d, and as __b whether a group goes on from the one before it."""
    gaps, groups = _split(text, GROUP)
    out = df.withColumn("__g", gaps).withColumn("__m", groups)
    goes_on = lambda m, i: F.concat(F.get("__g", i), F.when(F.startswith(m, F.lit("(")), "(").otherwise("")).rlike(BETWEEN) & ~F.startswith(m, F.lit("+"))
    out = out.withColumn("__p", F.flatten(F.transform("__g", lambda g, i: F.array(g, F.coalesce(F.get("__m", i), F.lit(""))))))
    return out.withColumn("__d", F.transform("__m", lambda m: F.length(digits(m)))).withColumn("__b", F.transform("__m", goes_on))


_RUNS = "array<struct<groups: int, size: bigint, whole: boolean, features: array<int>, labels: array<int>>>"


def runs(i: Column) -> Column:
    """(groups, size, whole, features, labels) of the runs from group i on that could be of some kind; see grouped()."""
    ahead = F.slice("__b", i + 2, RUN_DIGITS - 1)
    stop = F.array_position(ahead, F.lit(False)).cast("int")
    more = F.when(stop == 0, F.size(ahead)).otherwise(stop - 1)
    joined = lambda first, n: F.array_join(F.slice("__p", first, n), "")

    def seen(e: Column) -> Column:
        n = F.aggregate(F.slice("__d", i + 1, e + 1), F.lit(0), lambda a, b: a + b)
        return F.struct(e.alias("e"), F.when((n <= RUN_DIGITS) & ((n >= 10) | (e == 3)), joined(2 * i + 2, 2 * e + 1)).alias("text"))

    def whole(e: Column) -> Column:
        begins, ends = F.get("__b", i), F.coalesce(F.get("__b", i + e + 1), F.lit(False))
        return ~(begins | ends | F.endswith(F.get("__g", i), F.lit(_MASK)) | F.startswith(F.get("__g", i + e + 1), F.lit(_MASK)))

    def described(c: Column) -> Column:
        first = F.greatest(2 * i + 2 - 2 * RUN_DIGITS, F.lit(1))
        gap = F.array_join(F.transform(F.slice("__p", first, 2 * i + 2 - first), lambda x: F.right(x, F.lit(64))), "")
        after = F.concat(*[F.coalesce(F.get("__p", 2 * (i + c["e"]) + k), F.lit("")) for k in (2, 3)])
        around = F.array(F.struct(c["text"].alias("text"), gap.alias("gap"), after.alias("after")))
        found = F.transform(around, lambda a: F.struct((c["e"] + 1).alias("groups"), F.char_length(a["text"]).cast("long").alias("size"), whole(c["e"]).alias("whole"), features(a["text"], a["gap"], a["after"], 0).alias("features"), _labels(a["text"], None, 0, part=True).alias("labels")))
        return found[0]

    some = F.filter(F.transform(F.sequence(F.lit(0), more), seen), lambda c: c["text"].isNotNull() & (could_be("ip", c["text"]) | could_be("card", c["text"]) | could_be("phone", c["text"])))
    none = F.array().cast(_RUNS)
    return F.when((more > 0) | (F.get("__d", i) >= 10), F.transform(some, described)).otherwise(none)


def candidates(rows: DataFrame) -> DataFrame:
    """(row, kind, pos, skip, size, ok, features, labels, runs) of all base matches and candidates of (row, text). kind is the
    place in BASE, 4, 5, 7 and 8 are the generators, 6 has the digit groups left between base spans with the runs that begin there."""
    out = rows
    for i, pattern in (dict(enumerate(PATTERNS.values())) | GENERATORS).items():
        gaps, matches = _split(F.col("text"), pattern)
        out = out.withColumn(f"g{i}", gaps).withColumn(f"m{i}", matches)
    # runs lie within the numbers; only texts with numbers of enough digits are looked at
    long = F.exists("m5", lambda m: (F.length(digits(m)) >= 10) | could_be("ip", m) | m.rlike(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]"))
    out = out.withColumn("__t", F.when(long, F.col("text")).otherwise(""))
    for kind, pattern in PATTERNS.items():
        gaps, matches = _split(F.col("__t"), pattern)
        out = out.withColumn("__g", gaps).withColumn("__m", matches)
        masked = _replaced(lambda m, gap, after, kind=kind: F.when(passes(kind, m), F.repeat(F.lit(_MASK), F.char_length(m))))
        out = out.withColumn("__t", F.concat(F.element_at("__g", 1), F.array_join(masked, ""))).drop("__g", "__m")
    out = grouped(out, F.col("__t"))
    return out.select("row", F.explode(F.concat(*[_found(i) for i in (*range(len(BASE)), *GENERATORS)], _groups())).alias("c")).select("row", "c.*")


def _groups() -> Column:
    """The digit groups as structs like those of _found()."""
    none = F.array(F.lit(0)).cast("array<int>")

    def one(m: Column, k: Column) -> Column:
        lengths = F.char_length(F.get("__g", k)).cast("long").alias("skip"), F.char_length(m).cast("long").alias("size")
        return F.struct(F.lit(6).alias("kind"), k.alias("pos"), *lengths, F.lit(True).alias("ok"), none.alias("features"), none.alias("labels"), runs(k).alias("runs"))

    return F.transform("__m", one)


def _found(i: int) -> Column:
    """The matches m_i between the gaps g_i as an array of structs."""
    g, none = F.col(f"g{i}"), F.array(F.lit(0)).cast("array<int>")

    def one(m: Column, k: Column) -> Column:
        gap = F.element_at(g, k + 1)
        ok = passes(BASE[i], m) if i < 4 else F.lit(True)
        found, labels = none, none
        if i >= 4:
            # bound once: expressions below name it many times
            seen = F.array(F.struct((plain_address(m) if i == 7 else m).alias("m"), gap.alias("gap"), F.element_at(g, k + 2).alias("after")))
            both = F.transform(seen, lambda a: F.struct(features(a["m"], a["gap"], a["after"], KIND_OF[i]).alias("features"), _labels(a["m"], a["gap"], KIND_OF[i]).alias("labels")))[0]
            found, labels = both["features"], both["labels"]
        lengths = F.char_length(gap).cast("long").alias("skip"), F.char_length(m).cast("long").alias("size")
        return F.struct(F.lit(i).alias("kind"), k.alias("pos"), *lengths, ok.alias("ok"), found.alias("features"), labels.alias("labels"), F.lit(None).cast(_RUNS).alias("runs"))

    return F.transform(F.col(f"m{i}"), one)


@dataclass
class Model:
    """For each kind the trees (nested (feature, limit, left, right) or a number), the start and the threshold, in
    hundredths of a score."""

    trees: dict[str, list]
    start: dict[str, float]
    threshold: dict[str, float]

    def score(self, kind: str, found: Column) -> Column:
        """The score in whole hundredths, rounded down."""

        def walk(t) -> Column:
            if isinstance(t, float):
                return F.lit(t)
            return F.when(F.get(found, F.lit(t[0])) <= t[1], walk(t[2])).otherwise(walk(t[3]))

        total = F.lit(self.start[kind])
        for t in self.trees[kind]:
            total = total + walk(t)
        return F.floor(total * 100)

    def adds(self, found: Column, kinds: tuple[str, ...], scores: dict[str, Column] | None = None) -> Column:
        """The first of the kinds whose threshold the candidate reaches, as a place in KINDS (as), and its score; or nulls.
        scores: where they are known already."""
        out = F.lit(None).cast("struct<as: int, score: bigint>")
        for kind in reversed(kinds):
            if self.threshold[kind] < float("inf"):
                score = scores[kind] if scores else self.score(kind, found)
                out = F.when(score >= self.threshold[kind], F.struct(F.lit(KINDS.index(kind)).alias("as"), score.alias("score"))).otherwise(out)
        return out


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + 1.0))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, use: list[int], depth: int, rate: float):
    """A regression tree on gradients, by the gain of each cut of each feature."""
    best, gain = None, 1e-6
    if depth and len(x) > 1:
        whole = g.sum() ** 2 / (h.sum() + 1)
        for f in use:
            sums, weights = np.bincount(x[:, f], g), np.bincount(x[:, f], h)
            left_g, left_h = np.cumsum(sums)[:-1], np.cumsum(weights)[:-1]
            if not len(left_g):
                continue
            gains = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - whole
            k = int(gains.argmax())
            if gains[k] > gain:
                best, gain = (f, k), float(gains[k])
    if best is None:
        return rate * _leaf(g, h)
    f, k = best
    low = x[:, f] <= k
    return (f, k, _grow(x[low], g[low], h[low], use, depth - 1, rate), _grow(x[~low], g[~low], h[~low], use, depth - 1, rate))


def _value(t, x: np.ndarray) -> np.ndarray:
    if isinstance(t, float):
        return np.full(len(x), t)
    low = x[:, t[0]] <= t[1]
    return np.where(low, _value(t[2], x), _value(t[3], x))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, use: list[int], s: Settings) -> tuple[list, float]:
    """Trees and start of weighted rows; y is 1, 0 or one of the two values of rows without a label."""
    known = y >= 0
    positive = float(weight[y == 1].sum())
    if not positive:
        return [], 0.0
    fit, label, w = x[known], y[known], weight[known]
    start = float(np.log((positive + 0.5) / (w.sum() - positive + 0.5)))
    z, trees = np.full(len(fit), start), []
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-z))
        t = _grow(fit, w * (label - p), w * p * (1 - p), use, s.depth, s.rate)
        trees.append(t)
        z = z + _value(t, fit)
    return trees, start


def choose(level: np.ndarray, hits: np.ndarray, seen: np.ndarray, whole: np.ndarray, s: Settings) -> float:
    """The threshold of a kind from the counts of its levels: of positives, of labelled and of whole candidates."""
    down = np.argsort(-level)
    level, hits, seen, whole = level[down], hits[down], seen[down], whole[down]
    n, k, z = np.maximum(np.cumsum(seen), 1e-9), np.cumsum(hits), s.z
    # the lower end of Wilson's interval
    low = (k / n + z * z / (2 * n) - z * np.sqrt(np.maximum(k / n * (1 - k / n), 0) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    # no level may hide behind better ones above it
    sound = np.cumsum(2 * hits < whole) == 0
    last = np.flatnonzero((low >= s.precision) & sound)
    return float(level[last[-1]]) if len(last) else float("inf")


def train(found: DataFrame, settings: Settings | None = None) -> Model:
    """Boost on the candidates of a table of candidates()."""
    s = settings or Settings()
    # a run that is the whole of a number is there already
    parts = F.transform(F.filter("runs", lambda r: ~r["whole"]), lambda r: F.struct(r["features"].alias("features"), r["labels"].alias("labels")))
    each = found.where("kind >= 4").select(F.explode(F.when(F.col("kind") == 6, parts).otherwise(F.array(F.struct("features", "labels")))).alias("c")).select("c.*")
    counts = common.keep(each.groupBy("features", "labels").agg(F.count("*").alias("n")), "vectors")
    most = counts.orderBy(F.col("n").desc(), "features", "labels").limit(s.vectors).toArrow()
    model = Model({}, {}, {})
    x = np.array(most["features"].to_pylist(), np.int64).reshape(-1, len(FEATURES))
    y = np.array(most["labels"].to_pylist(), np.float64).reshape(-1, len(KINDS))
    w = np.array(most["n"].to_pylist(), np.float64)
    for k, kind in enumerate(KINDS):
        fitting = x[:, 0] == next(sort for sort, kinds in KINDS_OF.items() if kind in kinds) if len(x) else np.zeros(0, bool)
        use = [i for i, f in enumerate(FEATURES) if f not in HIDDEN[kind]]
        model.trees[kind], model.start[kind] = boost(x[fitting], y[fitting, k], w[fitting], use, s)
    levels = _levels(counts, model)
    common.drop(counts)
    for k, kind in enumerate(KINDS):
        model.threshold[kind] = choose(*levels[levels[:, 0] == k].T[1:], s) if model.trees[kind] else float("inf")
    return model


def _levels(counts: DataFrame, model: Model) -> np.ndarray:
    """Rows of kind, level, hits, seen, whole: the sums over all vectors of a level of a kind's score."""
    sort = F.element_at("features", 1)
    of = {kind: F.struct(F.lit(k).alias("k"), model.score(kind, F.col("features")).alias("level"), F.get("labels", F.lit(k)).alias("y")) for k, kind in enumerate(KINDS)}
    some = {n: F.array(*[of[kind] for kind in kinds]) for n, kinds in KINDS_OF.items()}
    each = counts.select("n", F.explode(F.when(sort == 1, some[1]).when(sort == 2, some[2]).otherwise(some[0])).alias("c")).select("n", "c.*")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    sums = each.groupBy("k", "level").agg(total(F.col("y") == 1).alias("hits"), total(F.col("y") >= 0).alias("seen"), total(F.col("y") >= OPEN).alias("whole")).toArrow()
    return np.array([sums[c].to_pylist() for c in ("k", "level", "hits", "seen", "whole")], np.float64).T.reshape(-1, 5)


def _maybe(text: Column) -> Column:
    return F.coalesce(text.rlike(rf"[0-9@]|{SPELLED_AT}"), F.lit(False))


def _rank(generator: Column, kind: Column, score: Column, size: Column, start: Column) -> tuple[Column, ...]:
    """What orders overlapping candidates, the best first."""
    return (F.when(generator == 6, 1).when(generator == 5, 2).otherwise(0).alias("o"), kind.alias("k"), (-score).alias("s"), (-size).alias("n"), start.cast("long").alias("at"))


def standing(ranked: Column) -> Column:
    """Those of ranked candidates (..., first, stop, as) that overlap no better one that stands itself."""
    one = F.slice(ranked, 1, 0)
    free = lambda kept, c: ~F.exists(kept, lambda k: (k["first"] < c["stop"]) & (c["first"] < k["stop"]))
    return F.aggregate(ranked, one, lambda kept, c: F.when(free(kept, c), F.concat(kept, F.array(c))).otherwise(kept))


def find(df: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """One row for each row of df: key, counts by kind, base (the base spans as text), spans (all spans as text)."""
    some = common.keep(df.where(_maybe(F.col(text))).select(F.col(key), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id()), "flagged")
    found = common.keep(candidates(some.select("row", "text")), "candidates")
    model = train(found, settings)
    running = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("skip") + F.col("size")).over(running)
    placed = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).where("ok")
    parts = placed.where("kind = 6 and size(runs) > 0").select("row", "start", F.explode("runs").alias("r")).select("row", F.lit(6).alias("kind"), "start", (F.col("start") + F.col("r.size")).alias("end"), "r.features")
    every = placed.where("kind <> 6").select("row", "kind", "start", "end", "features").unionByName(parts)
    # each score is a column, as it is compared and kept
    of = {kind: [g for g, sort in KIND_OF.items() if kind in KINDS_OF[sort]] for kind in KINDS if model.threshold[kind] < float("inf")}
    every = every.withColumns({f"s_{kind}": F.when(F.col("kind").isin(generators), model.score(kind, F.col("features"))) for kind, generators in of.items()})
    every = every.withColumn("added", model.adds(F.col("features"), tuple(of), {kind: F.col(f"s_{kind}") for kind in of}))
    kind = F.when(F.col("kind") < 4, F.col("kind")).otherwise(F.col("added.as"))
    chosen = every.select("row", (F.col("kind") < 4).alias("base"), kind.alias("as"), "start", "end", F.col("kind").alias("from"), F.col("added.score").alias("score")).where(F.col("as").isNotNull())
    # a base span that reaches over an added one, from either side
    in_row = Window.partitionBy("row").orderBy("start")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(in_row.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(in_row.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    touched = (F.coalesce(reach, F.lit(0).cast("long")) > F.col("start")) | (F.coalesce(ahead, F.col("end")) < F.col("end"))
    kept = chosen.withColumn("touched", touched).where("base or not touched")
    new = kept.where("not base")
    # clusters of added spans that overlap, and what stands of each
    before = F.max("end").over(Window.partitionBy("row").orderBy("start", "end", "from").rowsBetween(Window.unboundedPreceding, -1))
    ordered = Window.partitionBy("row").orderBy("start", "end", "from")
    new = new.withColumn("opens", F.coalesce(before <= F.col("start"), F.lit(True)).cast("int")).withColumn("cluster", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rank = _rank(F.col("from"), F.col("as"), F.col("score"), F.col("end") - F.col("start"), F.col("start"))
    stands = new.groupBy("row", "cluster").agg(standing(F.array_sort(F.collect_list(F.struct(*rank, F.col("start").alias("first"), F.col("end").alias("stop"), F.col("as").alias("as"))))).alias("c"))
    stands = stands.select("row", F.explode("c").alias("c")).select("row", F.lit(False).alias("base"), "c.as", F.col("c.first").alias("start"), F.col("c.stop").alias("end"))
    kept = kept.where("base").select("row", "base", "as", "start", "end").unionByName(stands)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("as") + 1)
    span = F.struct("start", "as", "end", F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("said"))
    said = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["said"]), ",")
    by_row = kept.groupBy("row").agg(
        *[F.count(F.when(F.col("base") & (F.col("as") == i), 1)).alias(f"n_{k}") for i, k in enumerate(BASE)],
        said(F.collect_list(F.when(F.col("base"), span))).alias("base"),
        said(F.collect_list(span)).alias("spans"),
    )
    zero, empty = F.lit(0).cast("long"), F.lit("")
    names = [f"n_{k}" for k in BASE]
    with_spans = some.select("row", key).join(by_row, "row", "left").select(key, *[F.coalesce(n, zero).alias(n) for n in names], *[F.coalesce(n, empty).alias(n) for n in ("base", "spans")])
    rest = df.where(~_maybe(F.col(text))).select(key, *[zero.alias(n) for n in names], empty.alias("base"), empty.alias("spans"))
    return with_spans.unionByName(rest)


def redact(df: DataFrame, text: str = "text", settings: Settings | None = None) -> DataFrame:
    """df with the spans of its texts replaced by [EMAIL], [IP], [CARD], [PHONE] and [SECRET]. Kinds are replaced one after
    another, then added candidates; gaps and matches are joined again, so that positions aren't needed."""
    learned = df.where(_maybe(F.col(text))).select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    model = train(candidates(learned), settings)
    flag = _maybe(F.col(f"`{text}`"))
    out = df.withColumn("__t", F.when(flag, F.col(f"`{text}`")))
    steps: list[tuple[str, object]] = [(PATTERNS[k], (lambda m, gap, after, k=k: F.when(passes(k, m), f"[{k.upper()}]"))) for k in BASE]
    for pattern, sort in ((ADDRESS, 1), (SPELLED, 1), (TOKEN, 2), (GROUP, 0), (NUMBER, 0)):
        kinds = KINDS_OF[sort]
        if any(model.threshold[k] < float("inf") for k in kinds):

            def added(m: Column, gap: Column, after: Column, pattern: str = pattern, sort: int = sort, kinds: tuple = kinds) -> Column:
                # bound once: the trees name a feature hundreds of times
                plain = plain_address(m) if pattern == SPELLED else m
                which = F.transform(F.array(features(plain, gap, after, sort)), lambda f: model.adds(f, kinds)["as"])[0]
                # what is left of a number beside a span counts by its runs only
                rest = F.lit(False) if sort else gap.rlike(rf"{_NAME}[\x20().:/-]{{0,2}}$") | after.rlike(rf"^[\x20().:/-]{{0,2}}{_NAME}")
                return F.when(which.isNotNull() & ~rest, F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), which + 1))

            steps.append((pattern, added))
    for pattern, replaced in steps:
        if pattern == GROUP:
            out = _without_runs(out, model)
            continue
        gaps, matches = _split(F.col("__t"), pattern)
        out = out.withColumn("__g", gaps).withColumn("__m", matches)
        out = out.withColumn("__t", F.when(F.col("__t").isNotNull(), F.concat(F.element_at("__g", 1), F.array_join(_replaced(replaced), "")))).drop("__g", "__m")
    return out.select(*[(F.coalesce("__t", F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`")) for c in df.columns])


def _without_runs(df: DataFrame, model: Model) -> DataFrame:
    """df with the runs of digit groups in __t that the model adds replaced."""
    own = df.columns
    out = grouped(df, F.col("__t"))

    def passing(m: Column, i: Column) -> Column:
        scored = F.transform(runs(i), lambda r: F.struct(r["groups"].alias("groups"), r["size"].alias("size"), model.adds(r["features"], NUMBERS).alias("a")))
        best = lambda r: F.struct(*_rank(F.lit(6), r["a"]["as"], r["a"]["score"], r["size"], i), i.alias("first"), (i + r["groups"]).alias("stop"), r["a"]["as"].alias("as"))
        return F.transform(F.filter(scored, lambda r: r["a"].isNotNull()), best)

    out = out.withColumn("__r", F.flatten(F.transform("__m", passing)))
    out = out.withColumn("__k", standing(F.array_sort("__r")))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def one(m: Column, i: Column) -> Column:
        within = F.filter("__k", lambda k: (k["first"] <= i) & (i < k["stop"]))
        after = F.when(F.exists(within, lambda k: i + 1 < k["stop"]), "").otherwise(F.get("__g", i + 1))
        shown = F.when(F.size(within) == 0, m).when(within[0]["first"] == i, F.element_at(names, within[0]["as"] + 1)).otherwise("")
        return F.concat(shown, after)

    changed = F.concat(F.element_at("__g", 1), F.array_join(F.transform("__m", one), ""))
    return out.withColumn("__t", F.when(F.size("__k") > 0, changed).otherwise(F.col("__t"))).select(*[F.col(f"`{c}`") for c in own])


def _replaced(by) -> Column:
    """The matches __m, or what they are replaced by, each with the gap after it."""
    g = F.col("__g")

    def one(m: Column, i: Column) -> Column:
        gap, after = F.element_at(g, i + 1), F.element_at(g, i + 2)
        return F.concat(F.coalesce(by(m, gap, after), m), after)

    return F.transform(F.col("__m"), one)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs).select("doc_id", *[f"n_{k}" for k in BASE], F.sha2("base", 256).alias("base_sha256"), "spans")
