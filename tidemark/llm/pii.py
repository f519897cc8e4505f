"""Personal data: base patterns, and further spans chosen by boosted trees over candidates. Native: DataFrame work only.

Spans come from splitting a text at a pattern: the pieces between the matches and the matches themselves give every
position by running totals. Base kinds (email, ip, card, phone) are exact. Beside them generators of high recall
propose spans that may overlap (assigned secrets, long mixed tokens, loose addresses, grouped digits). Gradient-boosted trees score each by the
span's format and what stands before and after it. They are fitted on about `per_label` candidates of
each weak label (strict formats or not; chosen by hash from one half of all candidates), whatever the size of the table; the threshold is the
lowest at which the scores reach `precision` on all candidates of the other half. Where a half lacks a label, all candidates serve both ends.
The trees are then compiled into one expression. Chosen spans are taken by falling score (ties: the earlier, then the
longer); one that overlaps a span taken before it is left out; one that overlaps a base span adds nothing.

Defined results: a null text counts as empty (no spans); texts are searched whole, and work grows with the number of spans, not
its square; spans are of code points, end exclusive; null ids pass through; repeated rows give equal results (and count once when the trees are taught); a table without any candidate of a strict format adds no spans (with a warning, unless it has no
candidates), one with nothing else adds every candidate; further columns pass through.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: The base patterns. Runs are tried from their start only (or from where the last match ended), which
#: finds the same matches as trying every character, in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

#: Generators: a name, a cheap test of the whole text, and the pattern of the span.
GENERATORS = (
    ("secret", r"(?i)(?:pass|pwd|secret|token|key)", r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\x20]{0,2}[=:][\x20]{0,2}[\"']?[A-Za-z0-9_+/.-]{6,}+[\"']?"),
    ("token", r"[A-Za-z][0-9]|[0-9][A-Za-z]", r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{12,}+"),
    ("address", r"@|(?i)\Wat\W", r"(?<![^\s<(])[^\s@<(]++(?:@|\x20?[\[(]at[\])]\x20?)[^\s@>)]{3,}+"),
    ("digits", r"[0-9][0-9 ./()-]{5,}", r"(?<![0-9A-Za-z])[(]?[0-9](?:[ ./()-]{0,2}[0-9]){6,}+"),
)
#: Formats that count as personal data or credentials when the trees are taught.
STRICT = (
    r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?(?=[^0-9]*[0-9])[A-Za-z0-9_+/.-]{8,}[\"']?$"
    r"|^[^@\s]+@[^@\s.]+\.[^@\s]+$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"
)
#: Of equally good splits the trees take the earlier feature, so what a span is comes before how long it is.
FEATURES = ("assigned", "at", "switches", "named_before", "digits", "uppers", "lowers", "others", "quoted", "number_before", "ends_sentence", "generator", "length")


@dataclass(frozen=True)
class Trees:
    """The trees, compiled: score(feature) is a column, given the column of each feature; threshold in the same unit."""

    nodes: tuple
    threshold: float

    def score(self, feature) -> Column:
        def column(node) -> Column:
            if len(node) == 1:
                return F.lit(float(node[0]))
            name, at, left, right = node
            return F.when(feature(name) <= float(at), column(left)).otherwise(column(right))

        total = F.lit(0.0)
        for weight, node in self.nodes:
            total = total + column(node) * float(weight)
        return total


def running_totals(lengths: Column, block: int = 256) -> Column:
    """The sum of all earlier elements, for each element of a column of int arrays (that column, not an expression)."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    n_blocks = F.ceil(F.size(lengths) / block).cast("int")
    sums = F.transform(F.sequence(F.lit(0), F.greatest(n_blocks - 1, F.lit(0))), lambda b: total(F.slice(lengths, b * block + 1, block)))
    return F.transform(lengths, lambda _, i: total(F.slice(sums, 1, (i / block).cast("int"))) + total(F.slice(lengths, (i / block).cast("int") * block + 1, i % block)))


BLOCK = 256
CHUNK = 4096


def block_tops(values: Column) -> Column:
    """The largest of each BLOCK elements of a column of int arrays (that column, not an expression)."""
    n_blocks = F.ceil(F.size(values) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n_blocks - 1, F.lit(0))), lambda b: F.array_max(F.slice(values, b * BLOCK + 1, BLOCK)))


def running_tops(values: Column, tops: Column) -> Column:
    """The largest of all earlier elements (0 at first), for each element; tops: block_tops(values), as a column. Work grows with n * (BLOCK + n / BLOCK)."""
    earlier = lambda i: F.greatest(F.array_max(F.slice(tops, 1, (i / BLOCK).cast("int"))), F.array_max(F.slice(values, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))
    return F.when(F.size(tops) > 0, F.transform(values, lambda _, i: F.coalesce(earlier(i), F.lit(0))))


class Steps:
    """A chain of projections that keeps the input's columns under other names, so that nothing clashes.

    Spark merges a projection into the next where its column is used once there. Used once in a lambda, it would be
    computed anew for each element; such columns are therefore also asked for their size outside of the lambda.
    """

    def __init__(self, df: DataFrame, text: str) -> None:
        self.names, self.kinds = df.columns, df.schema
        self.held = [f"_in_{i}" for i in range(len(df.columns))]
        raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
        self.df = df.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(df.columns, self.held, strict=True)], raw.alias("t"))
        self.made: list[str] = ["t"]

    def add(self, **columns: Column) -> Steps:
        self.df = self.df.select(*self.held, *self.made, *[c.alias(n) for n, c in columns.items()])
        self.made += columns
        return self

    def drop(self, *names: str) -> Steps:
        self.made = [m for m in self.made if m not in names]
        self.df = self.df.select(*self.held, *self.made)
        return self

    def spans(self, name: str, test: Column, pattern: str, around: bool = False) -> Steps:
        """An array of (s, e, m): start, end and text of every match; null where the test of the text fails. With `around`, also what stands before (20) and after (2), from the pieces between matches, so that no match counts from the text's start."""
        self.add(_m=F.when(test, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))))
        self.add(_p=F.when(F.size("_m") > 0, F.split("t", pattern, -1)))
        self.add(_l=F.zip_with("_m", F.slice("_p", 1, F.size("_m")), lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("n"))))
        self.add(_n=F.transform("_l", lambda x: x["g"] + x["n"]))
        self.add(_b=F.when(F.col("_n").isNotNull(), running_totals(F.col("_n"))))
        near = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))

        def found(b: Column, i: Column) -> Column:
            of = [(b + F.get("_l", i)["g"]).alias("s"), (b + F.get("_n", i)).alias("e"), F.get("_m", i).alias("m")]
            if around:
                of += [F.right(F.concat(near("_m", i - 1), near("_p", i)), F.lit(20)).alias("before"), F.left(F.concat(near("_p", i + 1), near("_m", i + 1)), F.lit(2)).alias("after")]
            return F.struct(*of)

        return self.add(**{name: F.transform("_b", found)}).drop("_m", "_p", "_l", "_n", "_b")


def luhn(m: Column) -> Column:
    """Whether the digits of a string pass the Luhn test."""
    digits = F.filter(F.split(F.reverse(m), ""), lambda x: x.rlike("[0-9]"))
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(F.transform(digits, value), F.lit(0), lambda s, x: s + x) % 10 == 0


def base_spans(steps: Steps) -> Steps:
    """Adds `base`, an array of (k, s, e): kind number, start and end, ordered by kind and start."""
    text = F.col("t")
    steps.spans("email", text.contains("@"), EMAIL).spans("ip", text.rlike(r"[0-9]\.[0-9]"), IP)
    steps.spans("card", text.rlike("[0-9](?:[ -]?[0-9]){15}"), CARD).spans("phone", text.contains("+"), PHONE)
    digits = lambda m: F.length(F.regexp_replace(m, "[^0-9]", ""))
    ok = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["m"].rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
        "card": lambda x: luhn(x["m"]),
        "phone": lambda x: digits(x["m"]).between(8, 15),
    }
    kinds = list(ok)
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")

    def numbered(i: int):
        return lambda x: F.struct(F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e"))

    found = [F.coalesce(F.transform(F.filter(k, ok[k]), numbered(i)), none) for i, k in enumerate(kinds)]
    return steps.add(base=F.concat(*found)).drop(*kinds)


def candidates(steps: Steps) -> Steps:
    """Adds `cand`, an array of spans with their features; those inside a base span are left out."""
    names = []
    for name, test, pattern in GENERATORS:
        steps.spans(f"c_{name}", F.col("t").rlike(test), pattern, around=True)
        names.append(f"c_{name}")
    count = lambda m, p: F.regexp_count(m, F.lit(p)).cast("double")
    flag = lambda c: c.cast("double")

    def described(g: int):
        def of(x: Column) -> Column:
            m, before, after = x["m"], x["before"], x["after"]
            return F.struct(
                x["s"].alias("s"), x["e"].alias("e"), m.alias("m"),
                F.length(m).cast("double").alias("length"), count(m, "[0-9]").alias("digits"), count(m, "[A-Z]").alias("uppers"), count(m, "[a-z]").alias("lowers"), count(m, "[^A-Za-z0-9]").alias("others"),
                count(m, "[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])").alias("switches"), flag(m.contains("@")).alias("at"), flag(m.rlike("[=:]")).alias("assigned"), flag(m.rlike("[\"']")).alias("quoted"),
                flag(before.rlike(r"(?i)(?:pass|token|key|secret|tel|phone|call|card|mail|ssn|iban|account)[^A-Za-z]*$")).alias("named_before"), flag(before.rlike(r"[0-9#+][ .]?$")).alias("number_before"),
                flag(after.rlike(r"^[.,;!?]?(?:\s|$)")).alias("ends_sentence"), F.lit(float(g)).alias("generator"),
            )

        return of

    steps.add(**{f"d{g}": F.transform(n, described(g)) for g, n in enumerate(names)}).drop(*names)
    kept = [f"d{g}" for g in range(len(names))]
    # null where the test of the whole text fails: only arrays that are there are joined
    steps.add(cand=F.flatten(F.filter(F.array(*kept), lambda a: a.isNotNull()))).drop(*kept)
    # base spans by start, with the reach of each block of them, so that a candidate is compared with the blocks near it only
    steps.add(by_start=F.sort_array(F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e")))))
    blocks = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("by_start"), F.lit(1)), F.lit(BLOCK)),
        lambda at: F.struct(at.alias("at"), F.get("by_start", at - 1)["s"].alias("s"), F.array_max(F.transform(F.slice("by_start", at, BLOCK), lambda b: b["e"])).alias("e")),
    )
    steps.add(blocks=blocks)
    meets = lambda x: lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])
    apart = lambda x: ~F.coalesce(F.exists("blocks", lambda k: meets(x)(k) & F.exists(F.slice("by_start", k["at"], BLOCK), meets(x))), F.lit(False))
    return steps.add(cand2=F.when(F.size("blocks") > 0, F.filter("cand", apart)).otherwise(F.col("cand"))).drop("cand", "by_start", "blocks")


#: Scores are counted in steps of 1 / STEPS.
STEPS = 1024


def fit(df: DataFrame, text: str = "text", per_label: int = 4000, precision: float = 0.98, rounds: int = 12, depth: int = 3) -> Trees | None:
    """Trees from about per_label candidates of each weak label, and the threshold from the scores of all held-out candidates of df."""
    # the outer form: a plain explode filters on the array's size, and that filter, with every step repeated in it, would
    # be pushed down to all documents
    rows = candidates(base_spans(Steps(df.select(F.col(f"`{text}`").alias("text")), "text"))).df.select("t", F.explode_outer("cand2").alias("c"))
    rows = rows.where("c is not null").select("c.*", F.xxhash64("t", "c.s", "c.e").alias("key"))
    table = written(rows.select(*FEATURES, F.col("m").rlike(STRICT).cast("double").alias("label"), "key", (F.pmod("key", F.lit(2)) == 0).alias("teach")), "pii-candidates")
    # a text that repeats is one
    table = written(table.distinct(), "pii-distinct")
    seen = {(r["teach"], r["label"]): r["count"] for r in table.groupBy("teach", "label").count().collect()}
    labels = {label for _, label in seen}
    if 1.0 not in labels:
        if labels:
            warnings.warn("no candidate has a strict format: no spans are added to the base kinds", stacklevel=2)
        return None
    if 0.0 not in labels:
        return Trees((), 0.0)  # every candidate has a strict format
    if len(seen) < 4:  # so few of a label that one half has none: all candidates teach and are held
        teach, held = table, table
        counts = {label: sum(n for (_, k), n in seen.items() if k == label) for label in labels}
    else:
        teach, held = table.where("teach"), table.where("not teach")
        counts = {label: seen[True, label] for label in labels}
    place = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30))
    most = F.when(F.col("label") == 1, F.lit(int(min(1.0, per_label / counts[1.0]) * (1 << 30)))).otherwise(F.lit(int(min(1.0, per_label / counts[0.0]) * (1 << 30))))
    sample = teach.where(place < most).orderBy("key", *FEATURES).coalesce(1)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, seed=7).fit(ready)

    def node(n) -> tuple:
        if n.subtreeDepth() == 0:
            return (n.prediction(),)
        return (FEATURES[n.split().featureIndex()], n.split().threshold(), node(n.leftChild()), node(n.rightChild()))

    trees = tuple((w, node(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True))
    scored = held.select(F.floor(Trees(trees, 0.0).score(F.col) * STEPS).alias("s"), "label")
    at = scored.groupBy("s").agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy(F.desc("s")).collect()  # scores lie within a few units of zero
    good = n = 0.0
    threshold = None
    for r in at:
        good, n = good + r["good"], n + r["n"]
        if good / n >= precision:
            threshold = r["s"] / STEPS
    if threshold is None:
        warnings.warn(f"no score reaches a precision of {precision}: no spans are added to the base kinds", stacklevel=2)
        return None
    return Trees(trees, threshold)


def find(df: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """df and `_pii`: an array of (kind, s, e), by kind (base kinds first, then the generators' in their order), then start."""
    steps = base_spans(Steps(df, text))
    kinds = F.array(*[F.lit(k) for k in ("email", "ip", "card", "phone", *[g[0] for g in GENERATORS])])
    as_span = lambda x: F.struct(F.get(kinds, x["k"]).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
    none = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    if trees is None:
        steps.add(_pii=F.transform("base", as_span))
    else:
        candidates(steps)
        scored = F.transform("cand2", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), trees.score(lambda n: c[n]).alias("p"), c["generator"].cast("int").alias("g")))
        steps.add(scored=scored).add(chosen=F.sort_array(F.filter("scored", lambda c: c["p"] >= trees.threshold))).drop("scored", "cand2")
        # runs of spans that overlap: a run begins where no earlier span reaches
        steps.add(ends=F.transform("chosen", lambda c: c["e"])).add(tops=block_tops(F.col("ends"))).add(reach=running_tops(F.col("ends"), F.col("tops"))).drop("ends", "tops")
        steps.add(begins=F.zip_with("chosen", "reach", lambda c, r: c["s"] >= r)).drop("reach")
        steps.add(firsts=F.filter(F.transform("begins", lambda b, i: F.when(b, i)), lambda i: i.isNotNull())).drop("begins")
        # in each, by falling score (ties: the earlier, then the longer); a span stays unless one that stayed before it overlaps
        ranked = lambda run: F.sort_array(F.transform(run, lambda c: F.struct(c["p"].alias("p"), (-c["s"]).alias("ns"), c["e"].alias("e"), c["g"].alias("g"))), asc=False)
        over = lambda x, y: (-x["ns"] < y["e"]) & (-y["ns"] < x["e"])
        kept = lambda run: F.aggregate(run, F.filter(run, lambda x: F.lit(False)), lambda held, x: F.when(F.exists(held, lambda y: over(x, y)), held).otherwise(F.concat(held, F.array(x))))
        steps.add(runs=F.transform("firsts", lambda at, j: ranked(F.slice("chosen", at + 1, F.coalesce(F.get("firsts", j + 1), F.size("chosen")) - at)))).drop("chosen", "firsts")
        steps.add(single=F.flatten(F.transform("runs", lambda run: F.when(F.size(run) == 1, run).otherwise(kept(run))))).drop("runs")
        more = F.transform("single", lambda x: F.struct((x["g"] + 4).alias("k"), (-x["ns"]).alias("s"), x["e"].alias("e")))
        steps.add(more=F.sort_array(more)).drop("single")
        steps.add(_pii=F.concat(F.transform("base", as_span), F.coalesce(F.transform("more", as_span), none)))
    return steps.df.select(*[F.col(h).alias(c) for h, c in zip(steps.held, steps.names, strict=True)], "_pii")


def redact(df: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """df with every span of `text` replaced by its kind in brackets; overlapping spans are replaced together."""
    found = find(df, trees, text)
    steps = Steps(found, text)
    pii = steps.held[steps.names.index("_pii")]
    steps.add(sorted=F.sort_array(F.transform(pii, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))))
    # a span that an earlier one reaches over adds no text; the reach is the largest end so far
    steps.add(ends=F.transform("sorted", lambda x: x["e"])).add(tops=block_tops(F.col("ends"))).add(reach=running_tops(F.col("ends"), F.col("tops")))
    # the text in chunks, so that a piece of it is not counted out from the text's start
    steps.add(chunks=F.when(F.size("sorted") > 0, F.regexp_extract_all("t", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))
    piece = lambda a, n: F.when((n > 0) & (F.size("chunks") > 0), F.substring(F.array_join(F.slice("chunks", (a / CHUNK).cast("int") + 1, (n / CHUNK).cast("int") + 2), ""), a % CHUNK + 1, n)).otherwise("")
    part = lambda x, i: F.when(x["s"] >= F.get("reach", i), F.concat(piece(F.get("reach", i), x["s"] - F.get("reach", i)), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")
    steps.add(parts=F.transform("sorted", part), last=F.coalesce(F.array_max(F.transform("sorted", lambda x: x["e"])), F.lit(0)))
    new = F.when(F.size("sorted") > 0, F.concat(F.array_join("parts", ""), F.substring(F.col("t"), F.col("last") + 1, F.length("t")))).otherwise(F.col("t"))
    steps.add(new=new)
    return steps.df.select(*[(F.col("new") if c == text else F.col(h)).alias(c) for h, c in zip(steps.held, steps.names, strict=True) if c != "_pii"])


def digests(df: DataFrame, trees: Trees | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base counts, base_sha256 and spans for each row."""
    found = find(df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), trees)
    base = ("email", "ip", "card", "phone")
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    def of_kind(k: str):
        return lambda x: x["kind"] == k

    counts = [F.size(F.filter("_pii", of_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    only = F.filter("_pii", lambda x: x["kind"].isin(*base))
    return found.select("doc_id", *counts, F.sha2(told(only), 256).alias("base_sha256"), told(F.col("_pii")).alias("spans"), F.lit(trees is not None).alias("trees_used"))
