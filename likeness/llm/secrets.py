"""Secret scans through a trigram inverted index, with DataFrame functions only.

Each rule's pattern is parsed into a Boolean query of the trigrams that any match must contain, in
disjunctive form. The index holds a posting (trigram, document) for every document and every trigram
that some rule asks for; intersecting the postings of a conjunction gives its candidate documents,
and the pattern runs on candidates only. A rule whose pattern has no mandatory trigram scans all.
"""

from __future__ import annotations


from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import fill, materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the group that is measured, and the least length of that group."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = False


# The three base rules of the scan's contract, in its order.
BASE_RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True),
)
# Published forms of other credentials; each has mandatory trigrams, so each is cheap to look for.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 20),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
)
RULES = BASE_RULES + MORE_RULES

#: Alternatives of a pattern beyond so many make a rule scan everything instead of growing its query.
MOST_STRINGS = 64
#: Candidates are broadcast to the documents up to so many; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


def _strings(tokens, most: int) -> list[list[str]]:
    """What a match spells, as alternatives: each a list of literal runs that all occur, in lower case.

    A part that does not spell a few fixed strings ends a run.
    """
    found: list[list[str]] = [[""]]

    def follow(options: list[list[str]]) -> None:
        nonlocal found
        joined = []
        for left, right in product(found, options):
            joined.append([*left[:-1], left[-1] + right[0], *right[1:]])
        found = joined if len(joined) <= most else [[*left, ""] for left in found]

    for op, arg in tokens:
        if op is sre.LITERAL:
            follow([[chr(arg).lower()]])
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            follow([[chr(a).lower()] for _, a in arg])
        elif op is sre.SUBPATTERN:
            follow(_strings(arg[-1], most))
        elif op is sre.BRANCH:
            follow([alternative for branch in arg[1] for alternative in _strings(branch, most)])
        elif op is sre.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
            follow([[""], *_strings(arg[2], most)])
        elif op is sre.MAX_REPEAT and arg[0] == arg[1] and arg[0] <= 8:
            for _ in range(arg[0]):
                follow(_strings(arg[2], most))
        else:
            found = [[*left, ""] for left in found]
    return found


def trigram_query(pattern: str, most: int = MOST_STRINGS) -> list[frozenset[str]]:
    """A disjunction of trigram sets, in lower case: a text that matches contains all of some set.

    Sets that contain another are dropped. The empty list means that nothing is mandatory.
    """
    sets = set()
    for runs in _strings(parser.parse(pattern), most):
        sets.add(frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2)))
    if not sets or frozenset() in sets:
        return []
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index: ``trigram, doc_id`` for the trigrams that the rules ask for.

    Letters are folded to lower case. A null doc_id has postings as well.
    """
    asked = sorted({t for r in rules for s in trigram_query(r.pattern) for t in s})
    folded = docs.select("doc_id", F.lower(fill(F.col("text"))).alias("_folded"))
    present = F.array_compact(F.array(*[F.when(F.contains("_folded", F.lit(t)), F.lit(t)) for t in asked])) if asked else F.array()
    return folded.select("doc_id", F.explode(present.cast("array<string>")).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, kinds``: the rules of which some conjunction has all its postings at the document."""
    spark = index.sparkSession
    rows = [
        (r.kind, n, len(terms), t) for r in rules for n, terms in enumerate(trigram_query(r.pattern)) for t in sorted(terms)
    ]
    if not rows:
        return index.select("doc_id", F.array().cast("array<string>").alias("kinds")).where(F.lit(False))
    # The rules' terms: as many rows as the patterns have trigrams, whatever the corpus.
    terms = spark.createDataFrame(rows, "kind string, nth int, wanted long, trigram string")
    met = index.join(F.broadcast(terms), "trigram").groupBy("doc_id", "kind", "nth", "wanted")
    # A repeated doc_id counts a trigram once.
    met = met.agg(F.collect_set("trigram").alias("_met")).where(F.size("_met") >= F.col("wanted"))
    return met.groupBy("doc_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Matches of a rule as an array of (start, rank, end, kind), in code points; leftmost, not overlapping."""
    # The run-length rules may demand the length in the pattern: their runs are maximal either way.
    pattern = rule.pattern
    if rule.group == 0 and pattern.endswith("+") and rule.kind in ("access", "hex"):
        head = len("AKIA") if rule.kind == "access" else 0
        pattern = pattern[:-1] + "{" + str(rule.least - head) + ",}"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else whole
    between = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    step = F.aggregate(
        F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), group.alias("part")),
        F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["gap"]) + F.length(m["whole"])).cast("bigint").alias("at"),
            F.when(
                F.length(m["part"]) >= rule.least,
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(m["gap"])).cast("bigint").alias("start"), F.lit(rank).alias("rank"),
                            (acc["at"] + F.length(m["gap"]) + F.length(m["whole"])).cast("bigint").alias("end"),
                            F.lit(rule.kind).alias("kind"),
                        )
                    ),
                ),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), step).otherwise(empty)


def _free(name: str, taken: list[str]) -> str:
    """``name``, longer where a column is called so, in any case."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``found``: array of (start, rank, end, kind) of all secrets, by start, then rule order.

    Offsets count code points, the end is exclusive. Null text is empty. A document whose id is
    repeated is a candidate if any of its rows is; each row is verified on its own text, and null ids
    are looked up like others. Columns named found are replaced, others pass through.
    """
    gated = tuple(r for r in rules if trigram_query(r.pattern))
    hits = materialize(candidates(postings(docs, gated), gated), "secret-candidates")
    hit, kinds = (_free(name, docs.columns) for name in ("_hit", "_kinds"))
    hits = hits.select(F.col("doc_id").alias(hit), F.col("kinds").alias(kinds))
    small = hits.count() <= BROADCAST_ROWS
    rows = docs.drop("found").join(F.broadcast(hits) if small else hits, F.col("doc_id").eqNullSafe(F.col(hit)), "left")
    text = fill(F.col("text"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    parts = [
        F.when(F.array_contains(kinds, r.kind), _spans(text, r, n)).otherwise(empty) if r in gated else _spans(text, r, n)
        for n, r in enumerate(rules)
    ]
    return rows.withColumn("found", F.array_sort(F.concat(*parts))).drop(hit, kinds)


def listed(found: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each document: counts of the base kinds, a digest of the base spans, all spans as text."""
    found = scan(docs.select("doc_id", "text"), rules)
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in rules if r.base]))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in rules if r.base],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
    )
