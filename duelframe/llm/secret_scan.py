"""Secret scans: rules are looked up in an inverted index of trigrams, then verified.

A null text is empty. Rows with an equal or null doc_id share their candidates,
which are verified on each row's own text. Other columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import cut, indexes, let, whole

MOST_STRINGS = 64  # spelled out per run of a regex; a larger class ends the run


@dataclass(frozen=True)
class Rule:
    """Matches of ``regex`` of which ``group`` has ``least`` characters or more."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token"))

# The kinds that are reported apart; runs of 32 and 16 characters are matched as
# such, which gives the same spans as filtering all runs.
BASE = (
    Rule(
        "assign",
        f"({_NAMES}|{either_case('api')}_?{either_case('key')})"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
    ),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)

# Public token formats.
ADDED = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("code_host", "gh[oprsu]_[A-Za-z0-9]{30,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("api", "AIza[A-Za-z0-9_-]{30,}"),
    Rule("payment", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("login", r"[a-z]{3,10}://[A-Za-z0-9._-]+:[A-Za-z0-9._-]+@[A-Za-z0-9.-]+"),
)


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """What a text with a match must have: every clause, by one of its alternatives.

    An alternative is a set of trigrams that occur together, in lower case. A
    regex without mandatory trigrams has no clause.
    """
    clauses: list[list[frozenset[str]]] = []
    run = {""}

    def end_run() -> None:
        nonlocal run
        grams = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run]
        if all(grams):
            clauses.append(sorted(set(grams), key=sorted))
        run = {""}

    def spelled(tree) -> set[str] | None:
        """All strings of a piece, None if there are too many."""
        found = {""}
        for op, arg in tree:
            if op is sre.LITERAL:
                more = {chr(arg).lower()}
            elif op is sre.IN and all(kind is sre.LITERAL for kind, _ in arg):
                more = {chr(c).lower() for _, c in arg}
            elif op is sre.SUBPATTERN:
                more = spelled(arg[3])
            elif op is sre.BRANCH:
                each = [spelled(branch) for branch in arg[1]]
                more = None if None in each else set().union(*each)
            elif op is sre.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
                more = spelled(arg[2])
                more = more and more | {""}
            elif op is sre.AT:
                more = {""}
            else:
                more = None
            if more is None or len(found) * len(more) > MOST_STRINGS:
                return None
            found = {a + b for a, b in product(found, more)}
        return found

    for item in _parser.parse(regex):
        strings = spelled([item])
        if strings is None or len(run) * len(strings) > MOST_STRINGS:
            end_run()
            run = strings or {""}
        else:
            run = {a + b for a, b in product(run, strings)}
    end_run()
    return clauses


def trigram_terms(rules: tuple[Rule, ...]) -> list[tuple[str, str, int, int, int]]:
    """``(trigram, kind, clause, alternative, bit)`` of all rules with mandatory trigrams."""
    return [
        (gram, rule.kind, c, a, bit)
        for rule in rules
        for c, clause in enumerate(trigram_query(rule.regex))
        for a, grams in enumerate(clause)
        for bit, gram in enumerate(sorted(grams))
    ]


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: ``(trigram, doc_id)`` for the given trigrams, letters in any case."""
    every = F.array(*[F.lit(g) for g in trigrams])
    found = let(F.lower(whole("text")), lambda t: F.filter(every, lambda g: F.contains(t, g)))
    return docs.select(F.explode(found).alias("trigram"), "doc_id")


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(doc_id, kinds)`` of texts that may match, from intersected postings.

    A list's intersection is kept as one bit per trigram. Groups are documents,
    so a frequent trigram makes no large group.
    """
    spark = docs.sparkSession
    terms = trigram_terms(rules)
    wanted = spark.createDataFrame(
        terms or [("", "", 0, 0, 0)], "trigram string, kind string, clause int, alt int, bit int"
    )
    clauses = {(kind, c, a): 0 for _, kind, c, a, _ in terms}
    for _, kind, c, a, bit in terms:
        clauses[kind, c, a] |= 1 << bit
    need, n_clauses = F.lit(None).cast("long"), F.lit(None).cast("int")
    for (kind, c, a), bits in clauses.items():
        same = (F.col("kind") == kind) & (F.col("clause") == c) & (F.col("alt") == a)
        need = F.when(same, F.lit(bits).cast("long")).otherwise(need)
    for kind in {kind for kind, _, _ in clauses}:
        n = len({c for k, c, _ in clauses if k == kind})
        n_clauses = F.when(F.col("kind") == kind, n).otherwise(n_clauses)
    listed = postings(docs, sorted({t[0] for t in terms}) or [""])
    # the rules' terms: as many as the rules have trigrams
    hits = listed.join(F.broadcast(wanted), "trigram")
    met = hits.groupBy("doc_id", "kind", "clause", "alt").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("got")
    )
    met = met.where(F.col("got") == need)
    full = met.groupBy("doc_id", "kind").agg(F.count_distinct("clause").alias("n"))
    full = full.where(F.col("n") == n_clauses)
    return full.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


_FOUND = "array<struct<start:int,no:int,end:int,kind:string>>"


def spans(text: Column, rule: Rule, order: int) -> Column:
    """``(start, kind_no, end, kind)`` of a rule's matches in code points, end exclusive.

    The text between matches gives their places. Running sums are made in runs of
    matches, as many as a run has: a list that grows by one is copied each time,
    so with ``n`` matches the copies take the square root of ``n`` times ``n`` steps.
    """
    regex = F.lit(rule.regex)
    none = F.array().cast(_FOUND)
    numbers = F.array().cast("array<int>")

    def running(values: Column, first: Column) -> Column:
        """``first`` and its sums with the values in turn, the last one left out."""
        start = F.struct(first.alias("at"), numbers.alias("out"))
        add = lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(values, start, add, lambda s: s["out"])

    def begins(steps: Column) -> Column:
        """What comes before each of the steps, which are as long as the text before their match and itself."""
        width = F.ceil(F.sqrt(F.size(steps))).cast("int")
        runs = let(width, lambda w: F.transform(indexes(w), lambda r: F.slice(steps, r * w + 1, w)))

        def summed(rs: Column) -> Column:
            totals = F.transform(rs, lambda r: F.aggregate(r, F.lit(0), lambda a, b: a + b))
            return let(
                running(totals, F.lit(0)),
                lambda firsts: F.flatten(F.transform(rs, lambda r, i: running(r, F.get(firsts, i)))),
            )

        return let(runs, summed)

    def placed(matches: Column) -> Column:
        tested = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else matches
        gaps = F.transform(F.slice(F.split(text, rule.regex, -1), F.lit(1), F.size(matches)), F.length)
        parts = F.arrays_zip(
            gaps.alias("gap"), F.transform(matches, F.length).alias("size"), F.transform(tested, F.length).alias("tested")
        )

        def out(ps: Column) -> Column:
            steps = F.transform(ps, lambda p: p["gap"] + p["size"])

            def each(firsts: Column) -> Column:
                one = lambda p, i: F.struct(
                    (F.get(firsts, i) + p["gap"]).alias("start"),
                    F.lit(order).alias("no"),
                    (F.get(firsts, i) + p["gap"] + p["size"]).alias("end"),
                    F.lit(rule.kind).alias("kind"),
                    p["tested"].alias("tested"),
                )
                long = F.filter(F.transform(ps, one), lambda s: s["tested"] >= rule.least)
                return F.transform(long, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "no", "end", "kind")]))

            return let(let(steps, begins), each)

        return let(parts, out)

    found = let(F.regexp_extract_all(text, regex, F.lit(0)), placed)
    return F.when(text.rlike(rule.regex), found).otherwise(none)


def shown(found: Column) -> Column:
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """``(doc_id, found)``: all spans of every text, by start and then by rule.

    Rules with mandatory trigrams look at candidates only; the others scan all.
    """
    indexed = {kind for _, kind, _, _, _ in trigram_terms(rules)}
    # written: a side still grouped by the key would keep rows with one key from being split
    kinds = cut(candidates(docs, rules).select(F.col("doc_id").alias("_id"), "kinds"), "secret-candidates")
    rows = docs.select("doc_id", whole("text").alias("_text")).join(
        kinds.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")), "left"
    )
    none = F.array().cast(_FOUND)
    each = []
    for order, rule in enumerate(rules):
        found = spans(F.col("_text"), rule, order)
        if rule.kind in indexed:
            found = F.when(F.array_contains("kinds", rule.kind), found).otherwise(none)
        each.append(found)
    return rows.select("doc_id", F.sort_array(F.concat(*each)).alias("found"))


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts and digests of the base kinds, and all spans, per document."""
    base = F.filter("found", lambda s: s["no"] < len(BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return find_secrets(docs).select(
        "doc_id",
        *[count(rule.kind).alias(f"n_{rule.kind}") for rule in BASE],
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("found")).alias("spans"),
    )
