"""Personal data by candidate gradient boosting.

``base_spans`` finds what strict patterns with checks accept (the base, always kept).  High-recall generators
propose further spans, which may overlap each other but no base span.  Boosted trees score each candidate by its
format and its context.  They learn base spans against all other candidates; what the base decides by (a leading
plus, the check digit, the size of an octet) isn't a feature, so the trees go by the look of a span and its surroundings.

The other candidates are unlabelled rather than negative: some are personal data in a format that the base doesn't
know.  Certain negatives are those that can't be: a check digit or octet that is wrong, too many or too few digits, a domain
without a top level.  They are never added.  On a held-out fold, the scores of a kind are cut into bins, and two shares that
grow with the score are fitted to them (pooled where neighbours disagree): base spans among base spans and certain negatives,
and base spans among base spans and unlabelled candidates.  The threshold is the smallest bin where the first is at least
``LEAST_PRECISION``, the second at least ``LEAST_KNOWN`` (up to 1 - ``LEAST_KNOWN`` of a kind's cases may be in other
formats) and that ``LEAST_SUPPORT`` base spans reach.  A kind without such a bin adds nothing.

Positions are code points, end exclusive.  Everything is DataFrame functions over one row at a time: matches
and gaps of a pattern give the positions, the learned trees are ``when`` expressions.  Running positions, overlaps and
choices are sweeps over sorted arrays in chunks, so a text with 100,000 matches takes time in proportion.  Only the
scored candidate counts by bin reach the driver.

Defined cases: null text is empty text and has no spans; of overlapping selected candidates the earliest start wins, then
the longest, the highest score, the order of kinds; repeated rows each count and each give a row; a very long text is
searched whole; a name in ``keep`` that is also a result's is refused, other columns are dropped; an input without candidates of
both classes, as an empty table, trains nothing and keeps the base.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort.llm.common import written

KINDS = ["email", "ip", "card", "phone"]
#: Base patterns, written so that matching takes linear time on any text (possessive loops, no restart within a run).
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[\x20-]?[0-9]){12})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to be searched at all.
GATE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
_WORD = r"""[^\s@<>"',;|]"""
_NUMBER = r"(?<![A-Za-z0-9])(?<![0-9][\x20().-])[+(]?(?=(?:[\x20().-]{0,2}[0-9]){9})[0-9](?:[\x20().-]{0,2}[0-9])++"
#: Generators: (kind, pattern, gate).  They overlap each other and the base.
GENERATORS = [
    ("email", rf"(?<!{_WORD}){_WORD}++\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]++(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]++)++", r"@|[(\[]at[)\]]"),
    ("ip", r"(?<![0-9.:])[0-9]{1,3}+(?:[.:][0-9]{1,3}+){3}(?![0-9])", r"[0-9][.:][0-9]"),
    ("card", _NUMBER, r"[0-9](?:[\x20().-]{0,2}[0-9]){8}"),
    ("phone", _NUMBER, r"[0-9](?:[\x20().-]{0,2}[0-9]){8}"),
]
#: Candidates that the trees learn from (a hash sample of all candidates, so that fitting stays bounded).
TRAIN_ROWS = 20_000
TREES, TREE_DEPTH = 16, 3
LEAST_PRECISION = 0.9
LEAST_KNOWN = 0.6
#: Held-out base spans that a threshold must rest on.
LEAST_SUPPORT = 20
BINS = 200
CONTEXT = 24
#: Elements of an array that a sweep handles at once, and characters of a block of text.
SWEEP, BLOCK = 256, 4096

FEATURES = ["length", "digits", "letters", "dots", "dashes", "spaces", "parens", "groups", "first_group", "last_group", "longest_group",
            "before", "after", "cue_email", "cue_ip", "cue_card", "cue_phone", "digits_near"]
CUES = {"cue_email": "mail|contact|@", "cue_ip": r"\bip\b|addr|host|server", "cue_card": "card|visa|credit|account|iban|pay",
        "cue_phone": r"phone|tel|call|fax|mobil|\+"}


def _count(s: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(s, f"[^{chars}]", "")).cast("double")


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once: an expression inside a lambda is computed anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sweep(rows: Column, zero: Column, step, emit) -> Column:
    """[emit(state, x) for x in rows] where state begins with ``zero`` and becomes step(state, x).

    An array that grows by one element is copied each time, so results are gathered in chunks of ``SWEEP``.
    """
    def of(r: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(r) / SWEEP).cast("int") - 1)), lambda i: F.slice(r, i * SWEEP + 1, SWEEP))
        none = F.filter(F.transform(F.slice(r, 1, 1), lambda x: emit(zero, x)), lambda x: F.lit(False))

        def inner(state: Column, chunk: Column) -> Column:
            return F.aggregate(chunk, F.struct(state.alias("st"), none.alias("out")),
                               lambda a, x: F.struct(step(a["st"], x).alias("st"), F.concat(a["out"], F.array(emit(a["st"], x))).alias("out")))

        def outer(a: Column, chunk: Column) -> Column:
            return _let(inner(a["st"], chunk), lambda x: F.struct(x["st"].alias("st"), F.concat(a["out"], F.array(x["out"])).alias("out")))

        return F.flatten(F.aggregate(chunks, F.struct(zero.alias("st"), F.filter(F.array(none), lambda x: F.lit(False)).alias("out")), outer, lambda a: a["out"]))

    return _let(rows, of)


def _found(text: Column, pattern: str, gate: str, context: bool = False) -> Column:
    """array<struct<s, e, m>> of the pattern's matches, with ``context`` also the characters to the ``left`` and ``right``:
    the gaps between matches give their places."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    n, edge = F.size(hits), F.array(F.lit(""))
    some = F.greatest(n - 1, F.lit(0))
    parts = {"g": F.slice(gaps, 1, n), "m": hits}
    if context:
        parts |= {"pm": F.concat(edge, F.slice(hits, 1, some)), "ng": F.slice(gaps, 2, n), "nm": F.concat(F.slice(hits, 2, some), edge)}
    rows = F.arrays_zip(*[v.alias(k) for k, v in parts.items()])

    def emit(at: Column, x: Column) -> Column:
        s = at + F.length(x["g"])
        more = [F.right(F.concat(x["pm"], x["g"]), F.lit(CONTEXT)).alias("left"), F.left(F.concat(x["ng"], x["nm"]), F.lit(CONTEXT)).alias("right")] if context else []
        return F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("m"), *more)

    kind = "array<struct<s:int,e:int,m:string" + (",left:string,right:string" if context else "") + ">>"
    swept = _sweep(rows, F.lit(0), lambda at, x: at + F.length(x["g"]) + F.length(x["m"]), emit)
    return F.when(text.rlike(gate), swept.cast(kind)).otherwise(F.array().cast(kind))


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind, array<struct<s, e>> of its valid base matches."""
    def of(kind: str) -> Column:
        hits = F.filter(_found(text, BASE[kind], GATE[kind]), lambda x: _valid(kind, x["m"]))
        return F.transform(hits, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    return {kind: of(kind) for kind in KINDS}


def tagged(base: dict[str, Column]) -> Column:
    """array<struct<s, k, e>> of all base spans by start, then kind as listed."""
    def of(k: int) -> Column:
        return F.transform(base[KINDS[k]], lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    return F.array_sort(F.concat(*[of(k) for k in range(len(KINDS))]))


def _possible(kind: str, m: Column) -> Column:
    """Whether a candidate can be personal data of its kind, whatever its format."""
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(m, r"\s", ""), r"[(\[]dot[)\]]", ".")
        return plain.rlike(r"[A-Za-z0-9].*(?:@|at[)\]]).*\.[A-Za-z]{2,}$")
    return _valid(kind, F.regexp_replace(m, ":", ".") if kind == "ip" else m)


def _features(x: Column) -> Column:
    """array<double> of a candidate's format and context, in the order of FEATURES."""
    m, left, right = F.ltrim(x["m"], F.lit("+")), x["left"], x["right"]  # the base needs the plus, other formats may lack it
    near = F.lower(left)
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")

    def side(c: Column) -> Column:
        return F.when(c == "", 0.0).when(c.rlike(r"^\s$"), 1.0).when(c.rlike("^[A-Za-z0-9]$"), 2.0).otherwise(3.0)

    def size(g: Column) -> Column:
        return F.coalesce(F.length(g).cast("double"), F.lit(0.0))

    longest = F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))).cast("double"), F.lit(0.0))
    values = {
        "length": F.length(m).cast("double"), "digits": _count(m, "0-9"), "letters": _count(m, "A-Za-z"), "dots": _count(m, "."),
        "dashes": _count(m, "-"), "spaces": _count(m, r"\s"), "parens": _count(m, "()"), "groups": F.size(groups).cast("double"),
        "first_group": size(F.get(groups, F.lit(0))), "last_group": size(F.get(groups, F.size(groups) - 1)), "longest_group": longest,
        "before": side(F.substring(left, -1, 1)), "after": side(F.substring(right, 1, 1)),
        "digits_near": _count(F.concat(left, right), "0-9"),
    } | {name: near.rlike(cue).cast("double") for name, cue in CUES.items()}
    return F.array(*[F.coalesce(values[f], F.lit(0.0)) for f in FEATURES])


def _free(found: Column, base: Column) -> Column:
    """The candidates that meet no base span: a sweep from the left knows the furthest end of base spans so far, one from
    the right the next start."""
    ends = F.transform(base, lambda b: F.struct(b["s"].alias("s"), F.lit(0).alias("t"), b["e"].alias("e"), F.get(F.slice(found, 1, 0), F.lit(0)).alias("c")))
    ours = F.transform(found, lambda c: F.struct(c["s"].alias("s"), F.lit(1).alias("t"), c["e"].alias("e"), c.alias("c")))

    def marked(state: Column, x: Column, hit: Column) -> Column:
        return F.struct(x["s"].alias("s"), x["t"].alias("t"), x["e"].alias("e"), x["c"].alias("c"), hit.alias("hit"))

    forth = _sweep(F.array_sort(F.concat(ends, ours)), F.lit(0), lambda top, x: F.when(x["t"] == 0, F.greatest(top, x["e"])).otherwise(top),
                   lambda top, x: marked(top, x, top > x["s"]))
    back = _sweep(F.reverse(forth), F.lit(2**31 - 1), lambda low, x: F.when(x["t"] == 0, x["s"]).otherwise(low),
                  lambda low, x: marked(low, x, x["hit"] | (low < x["e"])))
    kept = F.transform(F.filter(back, lambda x: (x["t"] == 1) & ~x["hit"]), lambda x: x["c"])
    return F.when((F.size(base) == 0) | (F.size(found) == 0), found).otherwise(kept)


def _proposed(text: Column) -> Column:
    """array<struct<s, e, k, m, left, right>>: proposals of all generators."""
    def of(kind: str, pattern: str, gate: str) -> Column:
        return F.transform(_found(text, pattern, gate, context=True), lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), F.lit(KINDS.index(kind)).alias("k"), x["m"].alias("m"), x["left"].alias("left"), x["right"].alias("right")))

    return F.concat(*[of(*g) for g in GENERATORS])


def _any_kind(k: Column, test) -> Column:
    return reduce(lambda rest, i: F.when(k == i, test(KINDS[i])).otherwise(rest), range(len(KINDS)), F.lit(False))


def candidates(proposed: Column, base: Column) -> Column:
    """array<struct<s, k, e, v, f>>: proposals that meet no base span, whether they can be personal data, and their features.
    ``proposed`` is the column of ``_proposed``, ``base`` that of ``tagged``."""
    return F.transform(_free(proposed, base), lambda x: F.struct(
        x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), _any_kind(x["k"], lambda kind: _possible(kind, x["m"])).alias("v"), _features(x).alias("f")))


def known(text: Column) -> Column:
    """array<struct<s, k, e, v, f>>: the base spans as examples, with their features."""
    def of(kind: str) -> Column:
        hits = F.filter(_found(text, BASE[kind], GATE[kind], context=True), lambda x: _valid(kind, x["m"]))
        return F.transform(hits, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), F.lit(True).alias("v"), _features(x).alias("f")))

    return F.concat(*[of(kind) for kind in KINDS])


@dataclass
class Boost:
    """Learned trees as nested lists [feature, threshold, left, right] or a leaf value, and thresholds by kind."""

    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=lambda: [2.0] * len(KINDS))  # above 1: adds nothing

    def probability(self, f: Column, k: Column) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, list):
                return F.lit(float(node))
            at, limit, left, right = node
            value = k.cast("double") if at == len(FEATURES) else F.get(f, F.lit(at))
            return F.when(value <= F.lit(limit), walk(left)).otherwise(walk(right))

        if not self.trees:
            return F.lit(0.0)
        score = reduce(lambda a, b: a + b, [F.lit(w) * walk(t) for w, t in zip(self.weights, self.trees)])
        return 1 / (1 + F.exp(-2 * score))

    def threshold(self, k: Column) -> Column:
        return F.element_at(F.array(*[F.lit(float(t)) for t in self.thresholds]), k + 1)

    def dumps(self) -> str:
        return json.dumps(self.__dict__)


def _tree(node) -> list | float:
    """A fitted tree's nodes."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return [int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())]


def fit(df: DataFrame, text: str = "text", seed: int = 1) -> Boost:
    """Learn trees and thresholds from the candidates of all documents."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    src = df.select(body.alias("text"), F.xxhash64(body).alias("h")).withColumn("known", known(F.col("text"))).withColumn("proposed", _proposed(F.col("text")))
    src = src.where("size(known) > 0 OR size(proposed) > 0")
    both = [F.transform("known", lambda c: F.struct(F.lit(True).alias("y"), c.alias("c"))),
            F.transform(candidates(F.col("proposed"), F.col("known")), lambda c: F.struct(F.lit(False).alias("y"), c.alias("c")))]
    each = src.select("h", F.explode(F.concat(*both)).alias("r"))
    rows = written(each.select("r.c.k", "r.y", "r.c.v", "r.c.f", F.xxhash64(F.lit(seed), "h", "r.c.s", "r.c.e").alias("h")), "candidates")
    fold = F.pmod("h", F.lit(5)) == 0
    n = rows.where(~fold).agg(F.count("*").alias("n"), F.count_if("y").alias("y")).first()
    if not n["y"] or n["y"] == n["n"]:
        return Boost()
    share = min(1.0, TRAIN_ROWS / n["n"])
    train = rows.where(~fold & (F.pmod(F.shiftright("h", 8), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))))
    flat = train.select(F.col("y").cast("double").alias("label"), *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(len(FEATURES))], F.col("k").cast("double").alias("kind"))
    packed = VectorAssembler(inputCols=[*[f"f{i}" for i in range(len(FEATURES))], "kind"], outputCol="features").transform(flat)
    model = GBTClassifier(maxIter=TREES, maxDepth=TREE_DEPTH, stepSize=0.3, seed=seed).fit(packed.select("features", "label").coalesce(1))
    out = Boost([_tree(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t.rootNode()) for t in model.trees], list(model.treeWeights))
    p = out.probability(F.col("f"), F.col("k"))
    counts = rows.where(fold).groupBy("k", F.floor(p * BINS).cast("int").alias("bin")).agg(
        F.count_if("y").alias("y"), F.count_if(~F.col("y") & F.col("v")).alias("open"), F.count_if(~F.col("y") & ~F.col("v")).alias("not")).collect()
    for k in range(len(KINDS)):
        out.thresholds[k] = threshold(sorted((r["bin"], r["y"], r["open"], r["not"]) for r in counts if r["k"] == k))
    return out


def rising(counts: list[tuple[int, int]]) -> list[float]:
    """Shares good / (good + bad) that never fall from one bin to the next: neighbours that disagree are pooled."""
    pools: list[list[float]] = []  # good, all, bins
    for good, bad in counts:
        pools.append([good, good + bad, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    return [g / n if n else 0.0 for g, n, size in pools for _ in range(int(size))]


def threshold(bins: list[tuple[int, int, int, int]]) -> float:
    """Of (bin, base spans, unlabelled, certain negatives) in order of bins: where the smallest good bin begins, 2 without one."""
    sure, seen = rising([(y, no) for _, y, _, no in bins]), rising([(y, u) for _, y, u, _ in bins])
    above, out = 0, 2.0
    for (b, y, _, _), p, q in zip(reversed(bins), reversed(sure), reversed(seen)):
        above += y
        if above >= LEAST_SUPPORT and p >= LEAST_PRECISION and q >= LEAST_KNOWN:
            out = b / BINS
    return out


def find_spans(df: DataFrame, model: Boost, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``text`` (null becomes empty), ``base`` and ``spans``: array<struct<s, k, e>> by start,
    then kind; ``k`` is the place in KINDS."""
    if clash := sorted({"text", "base", "spans"} & set(keep or [])):
        raise ValueError(f"columns to keep have names of results: {', '.join(clash)}")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(*[F.col(f"`{c}`") for c in keep or []], body.alias("text")).withColumn("base", tagged(base_spans(F.col("text"))))
    if not model.trees or min(model.thresholds) > 1:
        return rows.withColumn("spans", F.col("base"))
    scored = F.transform(F.filter(F.col("__cand"), lambda c: c["v"]), lambda c: F.struct(
        c["s"].alias("s"), (-c["e"]).alias("ends"), (-model.probability(c["f"], c["k"])).alias("p"), c["k"].alias("k")))
    chosen = F.array_sort(F.filter(scored, lambda c: -c["p"] >= model.threshold(c["k"])))
    swept = _sweep(F.col("__chosen"), F.lit(0), lambda end, c: F.when(c["s"] >= end, -c["ends"]).otherwise(end),
                   lambda end, c: F.struct(c["s"].alias("s"), c["k"].alias("k"), (-c["ends"]).alias("e"), (c["s"] >= end).alias("first")))
    added = F.transform(F.filter(swept, lambda c: c["first"]), lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))
    rows = rows.withColumn("__found", _proposed(F.col("text"))).withColumn("__cand", candidates(F.col("__found"), F.col("base"))).withColumn("__chosen", chosen)
    spans = F.when(F.size("__chosen") > 0, F.array_sort(F.concat("base", added))).otherwise(F.col("base"))
    return rows.withColumn("spans", spans).drop("__found", "__cand", "__chosen")


def counted(spans: Column) -> list[Column]:
    """n_<kind> long for each kind."""
    def of(k: int) -> Column:
        return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return [of(k) for k in range(len(KINDS))]


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans take the first one's name."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    last = F.greatest(F.lit(0), F.ceil(F.length(text) / BLOCK).cast("int") - 1)
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * BLOCK + 1, F.lit(BLOCK)))
    # a substring is counted off from its text's start, so pieces are taken from blocks
    cuts = _sweep(spans, F.lit(0), lambda at, x: F.greatest(at, x["e"]), lambda at, x: F.struct(at.alias("a"), x["s"].alias("b"), x["k"].alias("k")))
    every = F.concat(F.filter(cuts, lambda c: c["b"] >= c["a"]), F.array(F.struct(
        F.array_max(F.transform(spans, lambda x: x["e"])).alias("a"), F.length(text).alias("b"), F.lit(-1).alias("k"))))

    def piece(blocks: Column, c: Column) -> Column:
        low = F.floor(c["a"] / BLOCK).cast("int")
        part = F.array_join(F.slice(blocks, low + 1, F.ceil(c["b"] / BLOCK).cast("int") - low + 1), "")
        kept = F.when(c["b"] > c["a"], F.substring(part, c["a"] - low * BLOCK + 1, c["b"] - c["a"])).otherwise(F.lit(""))
        return F.concat(kept, F.when(c["k"] >= 0, F.element_at(names, c["k"] + 1)).otherwise(F.lit("")))

    joined = _let(blocks, lambda x: F.array_join(F.transform(every, lambda c: piece(x, c)), ""))
    return F.when(F.size(spans) > 0, joined).otherwise(text)
