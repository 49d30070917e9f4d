"""Personal data: base patterns, and more spans proposed by wide generators and judged by boosted trees.

All of it is column expressions over one row at a time, so nothing is shuffled and a text of any size stays in its row.
Places come from a pattern's matches and the pieces between them.

Base spans are those of four fixed patterns that pass their checks; they always stay.  Generators propose more:
addresses in disguise or with letters beyond ASCII, longer internet addresses, digit groups of any layout, the last as a
card and as a phone number at once, so proposals overlap each other and base spans.  Gradient boosted trees (MLlib) judge
each by its format and by the words around it, which count by how much they spoke for or against in training.  Each kind
has its own threshold: the least score from which on enough of the held-back examples are right.  The trees are written
out as a column expression, so judging is part of the same pass.

Training uses labelled examples: values laid out in many ways, among words of four languages, some telling and some not,
with look-alikes (dates, times, versions, order numbers) as the other class.  An example's label says how it was made;
no feature knows it.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import table
from .registry import query

#: Kinds in the order in which spans of one start are listed.
KINDS = ["email", "ip", "card", "phone"]

# The fixed patterns, so written that a run is read once: possessive, and started only where a run starts (or, for
# addresses, where the match before ended).  A card's digit count is part of its pattern.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}

_AT = r"(?:\x20?+[(\[{]\x20?+(?i:at)\x20?+[)\]}]\x20?+|\x20(?i:at)\x20|@)"
_DOT = r"(?:\x20?+[(\[{]\x20?+(?i:dot)\x20?+[)\]}]\x20?+|\x20(?i:dot)\x20|\.)"
#: Generators: name -> (pattern, hint, kinds proposed with the digits that they may have).
GENERATORS = {
    "address": (rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++{_AT}[\p{{L}}\p{{N}}-]++(?:{_DOT}[\p{{L}}\p{{N}}-]++)++", r"@|(?i)[(\[{]\x20?at\x20?[)\]}]|\x20dot\x20", [("email", 0, 1 << 30)]),
    "colons": (r"(?<![\p{L}0-9_:.])(?=[0-9A-Fa-f]*+:[0-9A-Fa-f]*+:)[0-9A-Fa-f:]++(?![\p{L}_])", ":[0-9A-Fa-f]*+:", [("ip", 0, 1 << 30)]),
    "digits": (r"(?<![\p{L}0-9_])[+(]?+[0-9](?:[\x20()./-]{0,2}+[0-9]){6,18}+(?![\p{L}_])", "[0-9]", [("card", 12, 19), ("phone", 7, 15)]),
}
#: Characters before and after a span in which the words around it are looked for.
BESIDE = 60
FEATURES = ["kind", "length", "digits", "groups", "first_group", "last_group", "blanks", "hyphens", "dots", "slashes", "brackets", "colons", "signs", "plus", "zero", "letters", "glued", "passes", "words_left", "words_right"]

Span = "struct<kind:int,start:bigint,end:bigint,value:string,left:string,right:string>"
_BLOCK = 256


def _blocks(steps: Column) -> Column:
    """Where each block of an array of lengths starts.  With these, running sums take no square of a long array's length."""
    numbers = F.sequence(F.lit(0), F.ceil(F.size(steps) / _BLOCK).cast("int") - 1)
    return F.aggregate(numbers, F.array(F.lit(0).cast("bigint")), lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + _sum(_block(steps, b))))


def _block(steps: Column, b: Column) -> Column:
    return F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda x, y: x + y)


def _ends(steps: Column, starts: Column) -> Column:
    """Running sums of an array of lengths; starts: those of its blocks."""
    inside = lambda at, b: F.transform(_block(steps, b), lambda x, i: at + _sum(F.slice(steps, b * _BLOCK + 1, i + 1)))
    return F.flatten(F.transform(F.slice(starts, F.lit(1), F.size(starts) - 1), inside))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    def add(total, i):
        x = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(i % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _octets(value: Column) -> Column:
    """Whether all parts of a dotted number are at most 255."""
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {"email": F.lit(True), "ip": _octets(value), "card": luhn(_digits(value)), "phone": n.between(9, 15)}[kind]


def _matched(rows: DataFrame, patterns: dict[str, tuple[str, str]], pieces: bool) -> DataFrame:
    """rows with `__m_<name>`: the matches of each pattern in `text`, and `__p_<name>`: what lies between, or its lengths."""
    rows = rows.withColumns({f"__m_{k}": F.when(F.col("text").rlike(hint), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))
                             for k, (p, hint) in patterns.items()})
    between = {}
    for k, (p, _) in patterns.items():
        cut = F.split("text", p, -1)
        between[f"__p_{k}"] = F.when(F.size(f"__m_{k}") > 0, cut if pieces else F.transform(cut, F.length))
    rows = rows.withColumns(between)
    ends = {}
    for k in patterns:
        gap = (lambda x: F.length(x)) if pieces else (lambda x: x)
        steps = F.transform(f"__m_{k}", lambda m, i: (F.length(m) + gap(F.get(f"__p_{k}", i))).cast("bigint"))
        ends[f"__s_{k}"] = F.when(F.size(f"__m_{k}") > 0, steps)
    rows = rows.withColumns(ends)
    rows = rows.withColumns({f"__b_{k}": F.when(F.size(f"__m_{k}") > 0, _blocks(F.col(f"__s_{k}"))) for k in patterns})
    return rows.withColumns({f"__e_{k}": F.when(F.size(f"__m_{k}") > 0, _ends(F.col(f"__s_{k}"), F.col(f"__b_{k}"))) for k in patterns})


def _clean(rows: DataFrame) -> DataFrame:
    return rows.drop(*[c for c in rows.columns if c[:4] in ("__m_", "__p_", "__s_", "__b_", "__e_")])


def base_spans(rows: DataFrame) -> DataFrame:
    """rows (with a string column `text`, not null) with `base`: (start, kind, end) of the base spans, by start and kind."""
    rows = _matched(rows, {k: (p, HINTS[k]) for k, p in BASE.items()}, pieces=False)
    found = []
    for i, k in enumerate(KINDS):
        spans = F.transform(f"__m_{k}", lambda m, j: F.struct((F.get(f"__e_{k}", j) - F.length(m)).alias("start"), F.lit(i).alias("kind"), F.get(f"__e_{k}", j).alias("end"), m.alias("value")))
        spans = F.filter(spans, lambda x: _valid(k, x["value"]))
        found.append(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return _clean(rows.withColumn("base", F.array_sort(F.concat(*found))))


def proposals(rows: DataFrame) -> DataFrame:
    """rows (with `text`) with `proposed`: the spans that the generators propose, each with what stands beside it."""
    rows = _matched(rows, {k: (p, hint) for k, (p, hint, _) in GENERATORS.items()}, pieces=True)
    found = []
    for g, (_, _, kinds) in GENERATORS.items():
        for kind, least, most in kinds:
            def span(m, j):
                end = F.get(f"__e_{g}", j)
                return F.struct(F.lit(KINDS.index(kind)).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), m.alias("value"),
                                F.substring(F.get(f"__p_{g}", j), -BESIDE, BESIDE).alias("left"), F.substring(F.get(f"__p_{g}", j + 1), 1, BESIDE).alias("right"))

            spans = F.transform(f"__m_{g}", span)
            if least:
                spans = F.filter(spans, lambda x: F.length(_digits(x["value"])).between(least, most))
            found.append(spans)
    return _clean(rows.withColumn("proposed", F.concat(*found).cast(f"array<{Span}>")))


def words_beside(text: Column) -> Column:
    """The words of a few characters, in small letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), F.lit(0))


def _count(value: Column, of: str) -> Column:
    return F.length(value) - F.length(F.translate(value, of, ""))


def features(x: Column, odds: Column) -> Column:
    """The values of FEATURES for a proposed span; odds: map from words (with their side and kind) to what they speak for."""
    value = x["value"]
    groups = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    left = words_beside(x["left"])

    def spoken(words, side):
        of = lambda w: F.coalesce(F.try_element_at(odds, F.concat(F.lit(side), x["kind"].cast("string"), F.lit(" "), w)), F.lit(0.0))
        return F.aggregate(words, F.lit(0.0), lambda a, w: a + of(w))

    near = F.concat(F.substring(x["left"], -1, 1), F.substring(x["right"], 1, 1))
    values = [
        x["kind"], F.length(value), F.length(_digits(value)), F.size(groups), F.length(F.coalesce(F.get(groups, F.lit(0)), F.lit(""))), F.length(F.coalesce(F.get(groups, F.size(groups) - 1), F.lit(""))),
        _count(value, " "), _count(value, "-"), _count(value, "."), _count(value, "/"), _count(value, "()[]{}"), _count(value, ":"), _count(value, "@"), value.startswith("+"), value.rlike("^[(]?0"),
        F.regexp_count(value, F.lit(r"\p{L}")), near.rlike(r"[\p{L}0-9_]"), F.when(x["kind"] == KINDS.index("card"), luhn(_digits(value))).otherwise(F.lit(False)),
        spoken(F.slice(left, F.greatest(F.size(left) - 2, F.lit(1)), F.lit(3)), "l"), spoken(F.slice(words_beside(x["right"]), 1, 1), "r")]
    # sliced, so that an array looked up in many places isn't copied into each of them by the optimizer
    return F.slice(F.array(*[v.cast("double") for v in values]), 1, len(values))


# Words and layouts of the labelled examples. `#`: a digit, `h`: a hexadecimal one, `N`, `D`: a name, a domain, `!`: the digit that makes it pass.
TELLING = {
    "email": "mail email write contact kontakt correo courriel adresse reach schreiben escribir", "ip": "host server address adresse connect ping router client direccion from",
    "card": "card visa mastercard payment karte kreditkarte carte tarjeta charge pay", "phone": "call phone tel mobile fax telefon anrufen telefono appeler ring cell handy"}
AGAINST = {
    "email": "arrive stay meet look stand bleiben", "ip": "time at um heure hora ratio start uhr clock", "card": "order invoice tracking serial isbn bestellung commande pedido id number",
    "phone": "order version date invoice page build ref isbn datum rechnung pages ticket seit between room"}
PLAIN = "the and of in to is that on with for der die und das nicht mit les des une que dans los las por una con there said it was new two"
NAMES = "anna.berg j.miller maria lopez.p k_weiss tom jürgen.müller zoé.léger peña.r info office a.kim ines.costa r2d noël"
DOMAINS = "example firma corp-mail uni post acme webhaus müller-bau società beispiel"
LAYOUTS = {
    "email": ["N (at) D (dot) com", "N [at] D.org", "N at D dot com", "N@D.de", "N {at} D {dot} net", "N(at)D.com", "N AT D DOT net", "N@D.D.es"],
    "ip": ["hhhh:hhhh:hhhh:hhhh:hhhh:hhhh:hhhh:hhhh", "fe80::hhhh:hhhh:hhhh:hhhh", "2001:db8::hhhh:h", "2a0h:hhhh:hhh::h", "::ffff:hhhh:hhhh"],
    "card": ["4###.####.####.###!", "5### / #### / #### / ###!".replace(" / ", "/"), "4###  ####  ####  ###!", "37##.######.####!", "4##############!", "5###-####-####-###!", "4### #### #### ###!"],
    "phone": ["(###) ###-####", "###-###-####", "0## ### ####", "0##/#######", "0# ## ## ## ##", "6## ### ###", "00## ### #######", "+## ### #######", "0### - ######", "###.###.####", "(0##) #######"]}
LOOK_ALIKES = {
    "email": ["it at D dot", "we at home dot", "N at D", "all at once dot com"],
    "ip": ["##:##:##", "#:##:##", "hh:hh:hh:hh:hh:hh", "a::b", "#:#:#", "::"],
    "card": ["2023##########", "################", "97# # ## ###### #", "20##-##-## ##:##", "#### #### ####", "####-####-####-####", "####.####.####.####", "1#############", "####/####/####/####"],
    "phone": ["20##-##-##", "##.##.20##", "##/##/####", "#######", "##########", "#.##.#.####", "####-####", "978-#-##-######-#", "20##/##/## ##", "### ### ###", "### - ###", "#############", "20##-##-## ## ##", "#.###.###"]}


def _pick(values: list[str], *salt) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.xxhash64("id", *[F.lit(s) for s in salt]), F.lit(len(values))).cast("int"))


def _filled(layout: Column) -> Column:
    """A value by its layout."""
    def digit(i, base):
        return F.pmod(F.xxhash64("id", i, F.lit(base)), F.lit(base))

    def put(c, i):
        return (F.when(c == "#", digit(i, 10).cast("string")).when(c == "h", F.lower(F.hex(digit(i, 16)))).when(c == "N", _pick(NAMES.split(), 7)).when(c == "D", _pick(DOMAINS.split(), 8)).otherwise(c))

    return F.array_join(F.transform(F.split(layout, ""), put), "")


def _passing(value: Column) -> Column:
    """value with the digit for `!` that makes it pass."""
    last = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: luhn(F.concat(_digits(value), d.cast("string"))))
    return F.when(value.contains("!"), F.replace(value, F.lit("!"), F.get(last, F.lit(0)).cast("string"))).otherwise(value)


def labelled(spark: SparkSession, n: int = 6000) -> DataFrame:
    """(id, text, kind, start, end, label): n examples, half of them look-alikes; the same for each call."""
    rows = spark.range(n, numPartitions=2).withColumns({"kind": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)).cast("int"), "label": (F.col("id") % 2).cast("int")})
    layout, cue = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, k in enumerate(KINDS):
        for label, layouts, words in ((1, LAYOUTS[k], TELLING[k]), (0, LOOK_ALIKES[k], AGAINST[k])):
            here = (F.col("kind") == i) & (F.col("label") == label)
            layout, cue = F.when(here, _pick(layouts, 2)).otherwise(layout), F.when(here, _pick(words.split(), 3)).otherwise(cue)
    plain = PLAIN.split()
    rows = rows.withColumn("layout", layout).withColumn("value", _filled(F.col("layout"))).withColumn("value", _passing(F.col("value")))
    cue = F.when(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(10)) < 6, F.concat(cue, _pick(["", ":", "", " is", "."], 5))).otherwise(_pick(plain, 6))
    rows = rows.withColumn("left", F.concat(_pick(plain, 9), F.lit(" "), _pick(plain, 10), F.lit(" "), cue, F.lit(" ")))
    text = F.concat("left", "value", _pick([" ", ", ", ". ", "\n"], 11), _pick(plain, 12), F.lit(" "), _pick(plain, 13))
    return rows.select("id", text.alias("text"), "kind", F.length("left").cast("bigint").alias("start"), (F.length("left") + F.length("value")).cast("bigint").alias("end"), "label")


@dataclass(frozen=True)
class Judge:
    """What training leaves: odds of words, trees as nested tuples, their weights, and a threshold for each kind."""

    odds: dict[str, float]
    trees: list
    weights: list[float]
    thresholds: list[float]

    def odds_map(self) -> Column:
        return F.from_json(F.lit(json.dumps(self.odds)), "map<string,double>")

    def score(self, f: Column) -> Column:
        """Probability that a span with features f is personal data."""
        def value(node):
            if isinstance(node, float):
                return F.lit(node)
            at, place, left, right = node
            return F.when(F.get(f, F.lit(at)) <= place, value(left)).otherwise(value(right))

        margin = reduce(lambda a, b: a + b, [F.lit(w) * value(t) for w, t in zip(self.weights, self.trees, strict=True)])
        return 1 / (1 + F.exp(-2 * margin))


def _tree(node) -> tuple | float:
    """A tree of the library as nested tuples."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def train(examples: DataFrame, trees: int = 20, depth: int = 4, precision: float = 0.98) -> Judge:
    """Learns from (id, text, kind, start, end, label): a quarter for the words' odds, half for the trees, the rest for the thresholds.

    Examples are bounded by who makes them; the odds keep words met at least three times.
    """
    examples = cut_lineage(examples.filter("text IS NOT NULL"))
    rows = proposals(examples).withColumn("x", F.explode("proposed"))
    hit = (F.col("x.kind") == F.col("kind")) & (F.col("x.start") == F.col("start")) & (F.col("x.end") == F.col("end")) & (F.col("label") == 1)
    rows = rows.select("id", "x", hit.cast("int").alias("hit"), F.pmod(F.xxhash64("id", F.lit(20)), F.lit(4)).alias("lot"))
    rows = cut_lineage(rows)
    beside = []
    left = words_beside(F.col("x.left"))
    for side, words in (("l", F.slice(left, F.greatest(F.size(left) - 2, F.lit(1)), F.lit(3))), ("r", F.slice(words_beside(F.col("x.right")), 1, 1))):
        beside.append(rows.filter("lot = 0").select("hit", F.explode(F.transform(words, lambda w: F.concat(F.lit(side), F.col("x.kind").cast("string"), F.lit(" "), w))).alias("word")))
    kinds = rows.filter("lot = 0").groupBy(F.col("x.kind").alias("kind")).agg(F.sum("hit").alias("pos"), F.count(F.lit(1)).alias("n")).collect()
    usual = {r.kind: (r.pos + 1) / (r.n - r.pos + 1) for r in kinds}
    met = beside[0].unionByName(beside[1]).groupBy("word").agg(F.sum("hit").alias("pos"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    # against the usual odds of the kind, so that a word never met says as little as one that is met everywhere
    odds = {r.word: round(math.log((r.pos + 1) / (r.n - r.pos + 1) / usual[int(r.word[1])]), 6) for r in met.orderBy("word").collect()}

    judge = Judge(odds, [], [], [])
    made = cut_lineage(rows.filter("lot > 0").select("lot", "hit", F.col("x.kind").alias("kind"), features(F.col("x"), judge.odds_map()).alias("f")))
    learn = made.filter("lot < 3").select(F.col("hit").cast("double").alias("label"), array_to_vector("f").alias("features"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11).fit(learn)
    judge = Judge(odds, [_tree(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights), [])

    # scores in thousandths, so few counts come back
    held = made.filter("lot = 3").select("kind", "hit", F.floor(judge.score(F.col("f")) * 1000).cast("int").alias("s"))
    counts = held.groupBy("kind", "s").agg(F.sum("hit").alias("pos"), F.count(F.lit(1)).alias("n")).orderBy("kind", F.desc("s")).collect()
    thresholds = []
    for i in range(len(KINDS)):
        pos, n, best = 0, 0, 2.0
        for r in (r for r in counts if r.kind == i):
            pos, n = pos + r.pos, n + r.n
            if pos >= precision * n:
                best = r.s / 1000
        thresholds.append(best)
    return Judge(odds, judge.trees, judge.weights, thresholds)


def find(docs: DataFrame, judge: Judge, doc_id: str = "doc_id", text: str = "text", *keep: str) -> DataFrame:
    """(doc_id, keep, base, spans) for each row of docs.

    base: (start, kind, end) of the base spans, kind being a place in KINDS.  spans: (start, kind, end, score) of these
    (score 1) and of the proposed ones at or over their kind's threshold, by start, kind and end; of spans with the same
    ends the base one stays, else the surest.  Places are code points, ends exclusive.  A null text is empty and has
    none; a null doc_id is kept; repeated rows give the same; other columns don't matter; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), *keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = proposals(base_spans(rows))
    odds = judge.odds_map()
    judged = F.transform("proposed", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), features(x, odds).alias("f")))
    rows = rows.withColumn("__judged", F.when(F.size("proposed") > 0, judged))
    scored = F.transform("__judged", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), (-judge.score(x["f"])).alias("minus"), x["kind"].alias("kind")))
    rows = rows.withColumn("__scored", F.when(F.size("proposed") > 0, scored))
    limits = F.array(*[F.lit(-t) for t in judge.thresholds])
    more = F.filter("__scored", lambda x: x["minus"] <= F.get(limits, x["kind"]))
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(-2.0).alias("minus"), x["kind"].alias("kind")))
    rows = rows.withColumn("__all", F.array_sort(F.concat(base, F.coalesce(more, F.filter(base, lambda x: F.lit(False))))))
    # of spans with the same ends the first stays
    again = lambda x, i: (i > 0) & (F.get("__all", F.greatest(i - 1, F.lit(0)))["start"] == x["start"]) & (F.get("__all", F.greatest(i - 1, F.lit(0)))["end"] == x["end"])
    kept = F.filter("__all", lambda x, i: ~again(x, i))
    spans = F.array_sort(F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.least(-x["minus"], F.lit(1.0)).alias("score"))))
    return rows.select("doc_id", *keep, "base", spans.alias("spans"), "text")


def named(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, judge: Judge, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every found span replaced by its kind in brackets; spans that overlap go as one, named by the first."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    rows = find(docs.withColumn("__null", F.col(text).isNull()).withColumn("__row", F.struct(*docs.columns)), judge, doc_id, text, "__row", "__null")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def put(s, x):
        apart = x["start"] >= s["at"]
        more = F.array(F.substr("text", (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.get(marks, x["kind"]))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(apart, F.concat(s["out"], more)).otherwise(s["out"]).alias("out"))

    done = F.aggregate("spans", start, put)
    clean = F.concat(F.array_join(done["out"], ""), F.substr("text", (done["at"] + 1).cast("int"), F.length("text")))
    clean = F.when(~F.col("__null"), F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))
    return rows.withColumn("__clean", clean).select(*[F.col("__clean").alias(c) if c == text else F.col(f"__row.{c}").alias(c) for c in docs.columns])


@query("op11_pii")
def op11(spark, folder):
    out = find(table(spark, folder, "documents"), train(labelled(spark)))
    counts = [F.size(F.filter("base", lambda x: x["kind"] == i)).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
