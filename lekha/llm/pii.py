"""Personal data by weak supervision, with DataFrame functions only.

Candidate spans come from regexes, strict and loose, and, for secrets, from long
runs of letters and digits. Three more labelers (a gazetteer of domains, issuers,
codes and forms of keys; the words and signs before the span; the variety of its
characters) vote besides the strict check. Expectation-maximisation over the counts
of vote patterns estimates each labeler's reliability and each pattern's
posterior; these train a logistic classifier of spans, which is applied as a
column expression. Spans that pass the strict check always stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekha.functions.text import prefix_sums
from lekha.plans.shared import written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: A text is cut at matches of these. A match can begin only where the one before
#: ends or where no character of its first class precedes, which is where the
#: leftmost match begins; the possessive forms never backtrack.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}[._/][0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}",
}
#: Cheap conditions without which a pattern cannot match.
NEEDS = {
    ("email", 0): r"@[A-Za-z0-9-]", ("ip", 0): r"[0-9]\.[0-9]", ("card", 0): r"[0-9](?:[\x20-]?[0-9]){11}", ("phone", 0): r"\+[0-9]",
    ("email", 2): r"[(\[]at[)\]]", ("ip", 2): r"[0-9A-Fa-f]:[0-9A-Fa-f]", ("card", 2): r"[0-9]{4}[._/][0-9]{4}[._/]", ("phone", 2): r"[0-9]{3}[.-][0-9]{4}",
    ("secret", 2): r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}",
}
#: The gazetteer: what speaks for a kind, and against it.
FOR = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)$", "ip": r"^(?!0|10\.|127\.|22[4-9]\.|2[3-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)", "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[a-z]_.*|sk-.*|xox[a-z]-.*|eyJ.*)=*$",
}
AGAINST = {"email": r"(?i)@(?:localhost|invalid)", "ip": r"^(?:0|127)\.", "card": r"^[0789]", "phone": r"^\+0", "secret": r"^(?:[0-9/_-]+|[A-Za-z]+(?:[/_-][A-Za-z0-9]{1,12})+)$"}
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|reach|kontakt|correo|courriel)", "ip": r"(?i)(?:\bip\b|address|host|server|login|adresse)",
    "card": r"(?i)(?:card|visa|credit|payment|karte|carte|tarjeta)", "phone": r"(?i)(?:phone|tel|call|mobile|fax|anruf|llam)",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)\W{0,6}$",
}
OTHER_CONTEXT = r"(?i)(?:version|release|isbn|serial|order no|invoice|\bv\.?)\s*$"
BEFORE = 32
#: So few different characters speak against a span, and so many for it.
VARIED = {"email": (4, 8), "ip": (1, 4), "card": (3, 6), "phone": (2, 5), "secret": (5, 10)}
#: Characters of the blocks in which texts are masked.
MASK_BLOCK = 4096
#: Least probability of a span that fails the strict check or is loose.
ACCEPT = 0.9
VOTES = ("check", "gazetteer", "context", "variety")


def matches(text: Column, pattern: str) -> Column:
    """start, end (code points, end exclusive) and text of the leftmost non-overlapping matches, and up to BEFORE characters between the last match and each."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(gaps, 1, F.size(gaps) - 1), lambda m, g: F.length(m) + F.length(g))
    before = prefix_sums(steps)
    each = F.zip_with(F.zip_with(found, before, lambda m, b: F.struct(m.alias("m"), b.alias("b"))), F.slice(gaps, 1, F.size(gaps) - 1),
                      lambda x, g: F.struct((x.b + F.length(g)).alias("start"), (x.b + F.length(g) + F.length(x.m)).alias("end"), x.m.alias("text"), F.substring(g, -BEFORE, BEFORE).alias("before")))
    return each


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    ds = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    return F.aggregate(
        F.transform(ds, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda s, d: s + d) % 10 == 0


def _strict_ok(kind: str, m: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    n = F.length(_digits(m))
    return {
        "email": F.lit(True), "ip": m.rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": F.when(n.between(16, 19), luhn(_digits(m))).otherwise(False), "phone": n.between(8, 15),
    }[kind]


def _candidates(kind: str, text: Column, loose: bool) -> Column:
    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    def row(m: Column) -> Column:
        check = F.lit(0) if loose else F.when(_strict_ok(kind, m.text), 1).otherwise(-1)
        kinds = F.size(F.array_distinct(F.split(m.text if kind in ("email", "secret") else _digits(m.text), "")))
        few = F.lit(False) if kind == "email" else _digits(m.text).rlike(r"([0-9])\1{5}|^(?:0123|1234)|^([0-9]{2,4})\2{2,}")
        few, many = few | (kinds <= VARIED[kind][0]), kinds >= VARIED[kind][1]
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), m.start.alias("start"), m.end.alias("end"), F.lit(loose).alias("loose"),
            check.alias("check"), vote(m.text.rlike(FOR[kind]), m.text.rlike(AGAINST[kind])).alias("gazetteer"),
            vote(m.before.rlike(CONTEXT[kind]), m.before.rlike(OTHER_CONTEXT)).alias("context"), F.when(few, -1).when(many, 1).otherwise(0).alias("variety"),
            F.least(F.floor(F.length(m.text) / 8), F.lit(3)).cast("int").alias("size"))

    pattern = (LOOSE if loose else STRICT)[kind]
    rows = F.transform(matches(text, pattern), row)
    if not loose and kind == "card":  # runs of few digits are numbers, not candidates
        rows = F.transform(F.filter(matches(text, pattern), lambda m: F.length(m.text).between(12, 64) & F.length(_digits(m.text)).between(12, 24)), row)
    return F.when(text.rlike(NEEDS[kind, 2 * loose]), rows)


def with_candidates(docs: DataFrame, text: str = "text", name: str = "__candidates") -> DataFrame:
    """docs and their candidate spans; a null text counts as empty. Loose ones that meet a strict span are left out."""
    t = F.coalesce(F.col(text), F.lit(""))
    strict_names, loose_names = [f"__{k}_0" for k in BASE], [f"__{k}_1" for k in KINDS]
    made = docs.withColumns({**{f"__{k}_0": _candidates(k, t, False) for k in BASE}, **{f"__{k}_1": _candidates(k, t, True) for k in KINDS}})
    none = F.array().cast(made.schema["__email_0"].dataType)
    strict = F.concat(*[F.coalesce(F.col(x), none) for x in strict_names])
    loose = F.concat(*[F.coalesce(F.col(x), none) for x in loose_names])
    some = F.filter(loose, lambda x: ~F.exists(strict, lambda s: (s.check == 1) & (s.start < x.end) & (x.start < s.end)))
    any_loose = F.coalesce(*[F.col(x) for x in loose_names]).isNotNull()
    return made.withColumn(name, F.when(any_loose, F.concat(strict, some)).otherwise(strict)).drop(*strict_names, *loose_names)


@dataclass
class Model:
    """reliability[vote][y][value]: P(vote = value | y); weights: of the classifier's features, by name."""

    prior: dict[int, float] = field(default_factory=dict)
    reliability: dict[str, list[dict[int, float]]] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)

    def probability(self, x: Column) -> Column:
        z = F.lit(self.weights.get("bias", -9.0))
        for name, w in sorted(self.weights.items()):
            if name != "bias":
                key, _, value = name.partition("=")
                z = z + F.when(x[key].cast("int") == int(value), w).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _features(r) -> list[str]:
    return ["bias", *(f"{k}={int(r[k])}" for k in ("kind", "loose", "size", *VOTES))]


def expectation_maximisation(rows: list[dict], rounds: int = 40) -> tuple[Model, list[float]]:
    """Labeler reliabilities, and the posterior of each row (kind, loose, size, votes, n)."""
    def majority(r):
        s = sum(r[v] * (2 if v == "check" else 1) for v in VOTES)
        return 0.9 if s > 1 else 0.1 if s < 0 else 0.4

    post, m = [majority(r) for r in rows], Model()
    for _ in range(rounds):
        for k in range(len(KINDS)):
            n = [(r["n"], p) for r, p in zip(rows, post, strict=True) if r["kind"] == k]
            m.prior[k] = (sum(a * p for a, p in n) + 1) / (sum(a for a, _ in n) + 2)
        for v in VOTES:
            m.reliability[v] = []
            for y in (0, 1):
                c = {-1: 1.0, 0: 1.0, 1: 1.0}
                for r, p in zip(rows, post, strict=True):
                    c[r[v]] += r["n"] * (p if y else 1 - p)
                m.reliability[v].append({k: x / sum(c.values()) for k, x in c.items()})
        new = []
        for r in rows:
            z = math.log(m.prior[r["kind"]] / (1 - m.prior[r["kind"]]))
            z += sum(math.log(m.reliability[v][1][r[v]] / m.reliability[v][0][r[v]]) for v in VOTES if r[v])  # zero is an abstention
            new.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        if max((abs(a - b) for a, b in zip(new, post, strict=True)), default=0) < 1e-6:
            break
        post = new
    return m, post


def train(rows: list[dict], steps: int = 300) -> Model:
    """EM, then a logistic regression of the posteriors on votes, kind, form and size."""
    m, post = expectation_maximisation(rows)
    total = sum(r["n"] for r in rows) or 1
    names = [_features(r) for r in rows]
    w = dict.fromkeys(sorted({f for x in names for f in x}), 0.0)
    for _ in range(steps):
        grad = {f: -0.001 * x for f, x in w.items()}
        for r, fs, p in zip(rows, names, post, strict=True):
            q = 1 / (1 + math.exp(-max(-30, min(30, sum(w[f] for f in fs)))))
            for f in fs:
                grad[f] += (p - q) * r["n"] / total
        w = {f: x + 2.0 * grad[f] for f, x in w.items()}
    m.weights = w
    return m


def fit(docs: DataFrame) -> Model:
    """Learn from the candidates of all documents (text)."""
    return _fit(with_candidates(docs.select("text")))


def _fit(rows: DataFrame) -> Model:
    """Learn from rows with candidates.

    What reaches the driver is counts by kind, form, size and votes: at most
    5 * 2 * 4 * 3**4 rows whatever the input. No candidates give a model that
    accepts nothing beyond the strict spans.
    """
    keys = ["kind", "loose", "size", *VOTES]
    rows = rows.select(F.explode("__candidates").alias("c")).select("c.*").groupBy(*keys).agg(F.count("*").alias("n"))
    return train(sorted((r.asDict() for r in rows.collect()), key=lambda r: [int(r[k]) for k in keys]))


def _spans(model: Model) -> Column:
    """array<struct<kind, start, end, base>> of the candidates that stay, by kind and start."""
    ok = F.filter("__candidates", lambda x: (x.check == 1) | (model.probability(x) >= ACCEPT))
    out = F.array_sort(F.transform(ok, lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"), (x.check == 1).alias("base"))))
    return F.when(F.size("__candidates") > 0, out).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean>>"))


def with_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs and __spans, array<struct<kind, start, end, base>>, by kind and start.

    Without a model one is fitted on docs; their candidates are then found once and
    written beside them.
    """
    made = with_candidates(docs)
    if model is None:
        made = written(made, "candidates")
        model = _fit(made)
    return made.withColumn("__spans", _spans(model)).drop("__candidates")


def span_string(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_secret, n_spans.

    Null and empty texts have no spans. Repeated rows give repeated results. An
    empty table gives an empty result; other columns are not read.
    """
    rows = docs.select("doc_id", "text")
    if model is None:
        rows = written(with_candidates(rows).drop("text"), "candidates")
        model = _fit(rows)
    else:
        rows = with_candidates(rows).drop("text")
    rows = rows.select("doc_id", _spans(model).alias("spans"))
    base = F.filter("spans", lambda s: s.base)
    counts = [F.size(F.filter(base, lambda s: s.kind == k)).cast("bigint").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(span_string(base).cast("binary"), 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans"),
                       F.size(F.filter("spans", lambda s: ~s.base)).cast("bigint").alias("n_added"),
                       F.size(F.filter("spans", lambda s: s.kind == KINDS.index("secret"))).cast("bigint").alias("n_secret"), F.size("spans").cast("bigint").alias("n_spans"))


def masked(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with every span of text replaced by <KIND>; where spans overlap, the first by start (then the longest) names the whole stretch.

    Null and empty texts stay as they are; other columns are kept, but for n_chars,
    which counts anew. Repeated rows are masked alike; an empty table stays empty.
    """
    rows = with_spans(docs, model)
    order = F.array_sort(F.transform("__spans", lambda s: F.struct(s.start.alias("start"), (-s.end).alias("end"), s.kind.alias("kind"))))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    none = F.lit(0)

    def part(blocks: Column, a: Column, b: Column) -> Column:
        """Characters a to b, from the blocks that hold them: no more is looked at."""
        first = F.floor(a / MASK_BLOCK).cast("int")
        some = F.array_join(F.slice(blocks, first + 1, F.floor(b / MASK_BLOCK).cast("int") - first + 1), "")
        return F.substring(some, a - first * MASK_BLOCK + 1, F.greatest(none, b - a))

    def replaced(blocks: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            piece = F.concat(part(blocks, acc.at, s.start), F.element_at(names, s.kind + 1))
            return F.struct(F.greatest(acc.at, -s.end).alias("at"), F.when(s.start >= acc.at, F.concat(acc.out, F.array(piece))).otherwise(acc.out).alias("out"))

        return F.aggregate(order, start, step, lambda acc: F.concat(F.array_join(acc.out, ""), part(blocks, acc.at, F.length("text"))))

    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{MASK_BLOCK}}}"), F.lit(0))
    text = F.when(F.size("__spans") == 0, F.col("text")).otherwise(F.transform(F.array(blocks), replaced)[0])
    out = rows.withColumn("text", text).drop("__spans")
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out
