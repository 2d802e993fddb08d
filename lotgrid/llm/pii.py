"""Personal data: fixed base patterns, then candidates judged by gradient-boosted trees; DataFrame and SQL functions only.

Base spans come from one pattern and one check for each kind and always stay. High-recall generators propose further
spans that may overlap: phone numbers without a plus, written-out addresses, IPv6, digit runs as long as a card number,
identity numbers, and opaque strings or values of assignments that may be secrets. Boosted trees score each from its
format and from what stands before and after it; a threshold for each generator, calibrated on held-out examples for
precision and recall, selects what is added. The trees run as SQL expressions, so whole texts are searched and judged
inside the JVM, without a shuffle.

Trees and thresholds are fitted on EXAMPLES generated texts (pii_examples), whose candidates and features are made by the
same expressions; only their feature rows come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .pii_examples import example_texts

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method finds; they come after the base kinds in the order of spans.
MORE_KINDS = ("secret", "id")
#: The base patterns, as fixed: the possessive forms and look-behinds match the same spans as the plain ones, without
#: going back over a text or recursing. A span may begin where the last one ended (\\G) or where its run of characters begins.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: What a text must have for a kind to be looked for.
NEEDS = {"email": "instr({t}, '@') > 0", "ip": "{t} RLIKE '[0-9][.][0-9]'", "card": "{t} RLIKE '[0-9][ -]?[0-9]'", "phone": "instr({t}, '+') > 0"}

#: Generators of candidates: kind, pattern, what a text must have. Candidates of one generator don't overlap.
GENERATORS = {
    "phone_groups": ("phone", r"(?<![0-9A-Za-z+.-])(?![0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9]))(?=\(?[0-9][\x20()./0-9-]{7})(?:\([0-9]{2,5}\)\x20?[0-9]{2,6}|[0-9]{2,5}[\x20./-]{1,2}[0-9]{2,6})(?:[\x20./-]{1,2}[0-9]{2,6}){0,5}(?![0-9A-Za-z])", "{t} RLIKE '[0-9]' AND {t} RLIKE '[0-9]{2}(?:[)] ?|[ ./-]{1,2})[0-9]{2}'"),
    "phone_zero": ("phone", r"(?<![0-9A-Za-z.-])00\x20?[1-9][\x20().0-9-]{6,18}[0-9](?![0-9A-Za-z])", "{t} RLIKE '[0-9]' AND {t} RLIKE '(?<![0-9])00 ?[1-9]'"),
    "phone_run": ("phone", r"(?<![0-9A-Za-z+./-])[0-9]{9,12}(?![0-9A-Za-z])", "{t} RLIKE '[0-9]' AND {t} RLIKE '[0-9]{9}'"),
    "email_spelled": ("email", r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,64}+\x20?[\[({](?i:at)[\])}]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[({](?i:dot)[\])}]\x20?)[A-Za-z0-9-]{1,63}){1,5}", "{t} RLIKE '[(\\\\[{](?i:at)[)\\\\]}]'"),
    "ip_six": ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}|:)(?![0-9A-Za-z:])", "{t} RLIKE '[0-9]' AND {t} RLIKE '[0-9A-Fa-f]:[0-9A-Fa-f:]'"),
    "card_run": ("card", r"(?<![0-9A-Za-z.-])[0-9]{13,19}(?![0-9A-Za-z])", "{t} RLIKE '[0-9]' AND {t} RLIKE '[0-9]{13}'"),
    "card_groups": ("card", r"(?<![0-9A-Za-z.])[0-9]{4}[\x20./_-][0-9]{4}[\x20./_-][0-9]{4}[\x20./_-][0-9]{3,4}(?![0-9A-Za-z])", "{t} RLIKE '[0-9]' AND {t} RLIKE '[0-9]{4}[ ./_-][0-9]{4}'"),
    "secret_opaque": ("secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]{0,40}[0-9])(?=[0-9+/_-]{0,40}[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}", "{t} RLIKE '[0-9]' AND {t} RLIKE '[A-Za-z0-9+/_-]{16}'"),
    "secret_assigned": ("secret", r"(?<=(?i:password|passwd|passphrase|pwd|secret|token|key|credentials?)[\x22']?\x20{0,2}[:=]\x20{0,2}[\x22']?)[^\s\x22':=,;]{6,}+", "{t} RLIKE '[:=]' AND {t} RLIKE '(?i:password|passwd|passphrase|pwd|secret|token|key|credential)'"),
    "id_dashed": ("id", r"(?<![0-9A-Za-z.-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z-])", "{t} RLIKE '[0-9]' AND {t} RLIKE '[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}'"),
    "id_account": ("id", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", "{t} RLIKE '[0-9]' AND {t} RLIKE '[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}'"),
}
_OWN = {
    "phone": "phone|telephone|telephones|tel|telefon|tel[eé]fono|t[eé]l[eé]phone|t[eé]l|mobile|mobil|m[oó]vil|portable|handy|cell|call|ring|dial|fax|sms|text|whatsapp|hotline|reach|contact|voicemail|rufnummer|llama|appelez",
    "email": "e-?mail|mail|write|contact|correo|courriel|reply|address|reach|send|inbox",
    "ip": "ip|ipv6|host|address|server|client|peer|gateway|login|login from|connected|adresse",
    "card": "card|visa|mastercard|amex|maestro|credit|debit|carte|tarjeta|karte|pan|pay|paid|payment|expiry|cvv|iban|account|konto|cuenta|compte",
    "secret": "token|secret|secrets|api|apikey|api_key|key|password|passwd|pwd|passphrase|credential|credentials|bearer|auth|authorization|access|private|jwt|cookie|session|passwort|contrase[nñ]a|clave",
    "id": "ssn|social|security|passport|passeport|pasaporte|reisepass|dni|nif|nie|national|insurance|identity|identity card|taxpayer|tax|iban|account|konto|cuenta|compte|bank",
}
#: Words that speak for something else with the same format.
OTHER_WORDS = "isbn|issn|ean|upc|doi|order|item|serial|sku|invoice|version|release|build|page|pages|fig|figure|table|chapter|section|date|year|years|ref|part|lot|article|case|model|batch|tracking|parcel|commit|revision|sha|sha1|sha256|md5|checksum|digest|hash|etag|uuid|guid|blob|file|path|url|image|score|result|total|sum|price|ticket|row|rows|line|lines|time|at|mac|slot|pos|position|offset|ratio|bestellung|commande|pedido|seite"
FEATURES = (
    "generator", "digits", "length", "marks", "luhn", "own_word", "own_near", "other_near", "secret_word", "distinct", "glued", "lead",
    "upper", "lower", "groups", "hex", "separator", "quoted", "prefix", "unit", "changes", "zeros", "date", "double",
)
EXAMPLES, PRECISION, RECALL, WINDOW, BLOCK = 9000, 0.95, 0.9, 40, 64

_SPAN = "struct<s: int, k: int, e: int, m: string>"


def _quoted(regex: str) -> str:
    return "'" + regex.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """SQL: whether the digits d pass the Luhn test."""
    digit = f"CAST(substr({d}, length({d}) - i, 1) AS INT)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (a, i) -> a + IF(i % 2 = 1, 2 * {digit} - IF({digit} > 4, 9, 0), {digit})) % 10 = 0"


def _valid(kind: str, m: str) -> str:
    if kind == "ip":
        return f"{m} RLIKE {_quoted(rf'\A{_OCTET}(?:\.{_OCTET}){{3}}\z')}"
    if kind == "card":
        return f"length({_digits(m)}) BETWEEN 12 AND 19 AND {_luhn(_digits(m))}"
    if kind == "phone":
        return f"length({_digits(m)}) BETWEEN 9 AND 15"
    return "true"


def located(t: str, regex: str, needs: str, number: int, valid: str) -> str:
    """SQL: spans (s, k, e, m) of the matches in t that pass, in code points; matches and the gaps between them alternate.

    A fold over BLOCK matches gives their places from the block's start; the blocks' lengths then shift them. So no array
    grows match by match with the text.
    """
    r = _quoted(regex)
    place = "acc.at + length(p.gap)"
    fold = f"""aggregate(block, named_struct('at', 0, 'out', CAST(array() AS ARRAY<{_SPAN}>)),
        (acc, p) -> named_struct(
          'at', {place} + coalesce(length(p.m), 0),
          'out', CASE WHEN p.m IS NOT NULL AND {valid.replace('@m', 'p.m')}
            THEN concat(acc.out, array(named_struct('s', {place}, 'k', {number}, 'e', {place} + length(p.m), 'm', p.m)))
            ELSE acc.out END))"""
    blocks = f"transform(sequence(0, (size(pairs) - 1) DIV {BLOCK}), i -> slice(pairs, i * {BLOCK} + 1, {BLOCK}))"
    starts = "aggregate(folded, named_struct('at', 0, 'all', CAST(array() AS ARRAY<INT>)), (acc, f) -> named_struct('at', acc.at + f.at, 'all', concat(acc.all, array(acc.at))), acc -> acc.all)"
    moved = f"flatten(zip_with(folded, {starts}, (f, o) -> transform(f.out, c -> named_struct('s', c.s + o, 'k', c.k, 'e', c.e + o, 'm', c.m))))"
    return f"""CASE WHEN {needs.replace('{t}', t)} THEN
      flatten(transform(array(zip_with(regexp_extract_all({t}, {r}, 0), split({t}, {r}, -1), (x, y) -> named_struct('m', x, 'gap', y))),
        pairs -> flatten(transform(array(transform({blocks}, block -> {fold})), folded -> {moved}))))
    ELSE CAST(array() AS ARRAY<{_SPAN}>) END"""


def _base(t: str) -> str:
    """SQL: all base spans, by start, then kind as listed."""
    each = [located(t, BASE[k], NEEDS[k], i, _valid(k, "@m")) for i, k in enumerate(KINDS)]
    return f"array_sort(concat({', '.join(each)}))"


def _candidates(t: str) -> str:
    """SQL: candidates with features x, by generator and start."""
    each = [located(t, regex, needs, g, "true") for g, (_, regex, needs) in enumerate(GENERATORS.values())]
    return f"transform(concat({', '.join(each)}), c -> {_described(t)})"


def _near(words: str, text: str, end: bool = False) -> str:
    """SQL: whether one of the words stands in text; end: as its last word, but for marks and one more short word."""
    tail = r"[^\p{L}]{0,6}(?:\p{L}{1,3}[^\p{L}]{1,3})?\z" if end else r"(?![\p{L}])"
    return f"IF({text} RLIKE {_quoted(rf'(?i)(?<![\p{{L}}])(?:{words}){tail}')}, 1, 0)"


def _by_kind(make) -> str:
    """SQL: make(words of the kind) for the kind of candidate c's generator."""
    kinds = [v[0] for v in GENERATORS.values()]
    return "CASE " + " ".join(f"WHEN c.k IN ({', '.join(str(g) for g, k in enumerate(kinds) if k == kind)}) THEN {make(words)}" for kind, words in _OWN.items()) + " END"


def _described(t: str) -> str:
    """SQL: candidate c with its features in the order of FEATURES."""
    d = _digits("c.m")
    before = f"substr({t}, greatest(1, c.s + 1 - {WINDOW}), least({WINDOW}, c.s))"
    after = f"substr({t}, c.e + 1, 12)"
    edges = f"concat(substr({t}, greatest(1, c.s), least(1, c.s)), substr({t}, c.e + 1, 1))"
    values = {
        "generator": "c.k", "digits": f"length({d})", "length": "c.e - c.s", "marks": "length(regexp_replace(c.m, '[0-9A-Za-z]', ''))",
        "luhn": f"IF(length({d}) BETWEEN 2 AND 40 AND {_luhn(d)}, 1, 0)",
        "own_word": _by_kind(lambda words: _near(words, before, True)), "own_near": _by_kind(lambda words: _near(words, before)),
        "other_near": _near(OTHER_WORDS, before), "secret_word": _near(_OWN["secret"], before, True),
        "distinct": "size(array_distinct(split(lower(c.m), '')))", "glued": f"IF({edges} RLIKE '[A-Za-z0-9@#$%&*/\\\\\\\\=_]', 1, 0)",
        "lead": f"coalesce(try_cast(substr({d}, 1, 1) AS INT), -1)", "upper": "length(regexp_replace(c.m, '[^A-Z]', ''))",
        "lower": "length(regexp_replace(c.m, '[^a-z]', ''))", "groups": r"size(regexp_extract_all(c.m, '[0-9A-Za-z]+', 0))",
        "hex": "IF(c.m RLIKE '^[0-9a-fA-F]+$', 1, 0)", "separator": f"IF({before} RLIKE '[:=] ?.?$', 1, 0)", "quoted": f"IF({edges} RLIKE '[\"\\']', 1, 0)",
        "prefix": "IF(c.m RLIKE '^(AKIA|ASIA|AIza|gh[opsu]_|github_pat_|sk_|pk_|sk-|rk_|xox[abprs]-|eyJ|glpat-|npm_)', 1, 0)",
        "unit": f"IF({after} RLIKE {_quoted(r'(?i)^\x20?(?:%|€|\$|£|[kmc]m|kg|g|mb|gb|kb|ms|s|h|px|usd|eur|euros?|dollars?|pages?|points?|bytes|years?)(?![\p{L}])')}, 1, 0)",
        "changes": r"size(regexp_extract_all(c.m, '[A-Za-z]+', 0)) + size(regexp_extract_all(c.m, '[0-9]+', 0))",
        "date": "IF(c.m RLIKE '^(?:(?:19|20)[0-9]{2}[-./ ][01]?[0-9][-./ ][0-3]?[0-9]|[0-3]?[0-9][-./ ][01]?[0-9][-./ ](?:19|20)[0-9]{2})', 1, 0)",
        "double": "IF(contains(c.m, '::'), 1, 0)", "zeros": f"length(regexp_extract({d}, '0*$', 0))",
    }
    return f"named_struct('s', c.s, 'k', c.k, 'e', c.e, 'x', array({', '.join(f'CAST({values[f]} AS DOUBLE)' for f in FEATURES)}))"


def trees_sql(trees: Trees, x: str) -> str:
    """SQL for the margin of a row whose features are the array x."""
    inner = trees.feature.shape[1]

    def node(t: int, k: int) -> str:
        if k >= inner:
            return f"{float(trees.leaf[t, k - inner])!r}D"
        if not np.isfinite(trees.threshold[t, k]):
            return node(t, 2 * k + 1)
        return f"IF({x}[{int(trees.feature[t, k])}] > {float(trees.threshold[t, k])!r}D, {node(t, 2 * k + 2)}, {node(t, 2 * k + 1)})"

    return " + ".join([f"{float(trees.base)!r}D", *(node(t, 0) for t in range(len(trees.feature)))])


@dataclass(frozen=True)
class PiiModel:
    """margin: SQL over a candidate c; least: the margin from which a candidate of each generator is taken."""

    margin: str
    least: tuple[float, ...]

    def find(self, docs: DataFrame) -> DataFrame:
        """doc_id, base and added (arrays of spans: start, end, kind), for each row of docs.

        Null and empty texts have no spans; very long texts are searched whole, in time linear in their length; only the
        product of one text's candidates and spans counts besides. Added spans overlap neither base spans nor each other: of candidates that overlap, the one with
        the largest margin stays, then the first. Repeated rows are each searched, a null id stays null; other columns
        aren't read, whatever their names; an empty table gives no rows.
        """
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
        rows = rows.withColumn("base", F.expr(_base("t"))).withColumn("cands", F.expr(_candidates("t")))
        chosen = " ".join(f"WHEN {g} THEN {v!r}D" for g, v in enumerate(self.least))
        rows = rows.withColumn("scored", F.expr(f"transform(cands, c -> named_struct('z', {self.margin}, 's', c.s, 'e', c.e, 'g', c.k))"))
        rows = rows.withColumn("scored", F.expr(f"filter(scored, c -> c.z >= CASE c.g {chosen} END AND NOT exists(base, b -> b.s < c.e AND c.s < b.e))"))
        apart = "filter(scored, c -> NOT exists(scored, o -> o.s < c.e AND c.s < o.e AND (o.z > c.z OR (o.z = c.z AND (o.s < c.s OR (o.s = c.s AND o.g < c.g))))))"
        named = KINDS + MORE_KINDS
        kinds = f"array({', '.join(map(repr, named))})"
        own = f"array({', '.join(str(named.index(v[0])) for v in GENERATORS.values())})"
        rows = rows.withColumn("added", F.expr(f"array_sort(transform({apart}, c -> named_struct('s', c.s, 'k', {own}[c.g], 'e', c.e)))"))
        name = lambda col: f"transform({col}, c -> named_struct('start', c.s, 'end', c.e, 'kind', {kinds}[c.k]))"
        return rows.select("doc_id", F.expr(name("base")).alias("base"), F.expr(name("added")).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans in their order, joined by commas."""
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def all_spans(base: str, added: str) -> str:
    """SQL: both lists in order of start, then kind as listed."""
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS + MORE_KINDS))
    keyed = f"transform(concat({base}, {added}), c -> named_struct('start', c.start, 'k', CASE c.kind {order} END, 'end', c.end, 'kind', c.kind))"
    return f"transform(array_sort({keyed}), c -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind))"


@cache
def _fitted(app: str) -> PiiModel:
    spark = SparkSession.active()
    wanted = example_texts(EXAMPLES)
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(wanted)], "i int, t string")
    found = rows.select("i", F.explode(F.expr(_candidates("t"))).alias("c")).select("i", "c.k", "c.s", "c.e", "c.x").collect()
    found.sort(key=lambda r: (r.i, r.k, r.s))
    x, kind = np.array([r.x for r in found]), np.array([r.k for r in found])
    own = [v[0] for v in GENERATORS.values()]
    y = np.array([_meets(wanted[r.i], own[r.k], r.s, r.e) for r in found], float)
    fold = np.array([r.i % 3 == 0 for r in found])
    trees = fit(x[~fold], y[~fold], rounds=40, depth=4, rate=0.25)
    z = trees.margin(x)
    return PiiModel(trees_sql(trees, "c.x"), tuple(threshold(z[fold & (kind == g)], y[fold & (kind == g)]) for g in range(len(GENERATORS))))


def _meets(example: tuple[str, str, int, int], kind: str, start: int, end: int) -> bool:
    """Whether a candidate is of the example's kind and covers its span but for a fifth of both."""
    _, want, s, e = example
    return kind == want and 5 * (min(e, end) - max(s, start)) >= 4 * (max(e, end) - min(s, start))


def threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The least margin whose examples are right in PRECISION of cases, if it keeps RECALL of the wanted; else the best F1.

    Nothing is taken (infinitely high) if no example is wanted.
    """
    if not y.sum():
        return 1e9
    marks = np.unique(z)
    taken = [z >= m for m in marks]
    right, all_ = np.array([y[t].sum() for t in taken]), np.array([t.sum() for t in taken])
    precision, recall = right / all_, right / y.sum()
    good = np.flatnonzero((precision >= PRECISION) & (recall >= RECALL))
    best = int(good[0]) if len(good) else int((2 * precision * recall / np.maximum(precision + recall, 1e-9)).argmax())
    below = marks[best - 1] if best else marks[best] - 1.0
    return float((marks[best] + below) / 2)


def default_model(spark: SparkSession) -> PiiModel:
    return _fitted(spark.sparkContext.applicationId)
