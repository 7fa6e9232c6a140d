"""Personal data by weak supervision, in DataFrame functions only.

Base spans come from formats and their checks. Further candidates (national phone numbers, account-like digit groups,
secrets) are judged by labelers that vote for, against or not at all: formats, prefix lists and context. Votes are
counted by pattern over all documents; expectation-maximisation on the counts estimates how reliable each labeler is,
and a logistic span classifier is trained on its posteriors. Its weights become one Column expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import stored

# Formats of the base kinds, in the order in which spans of one start are listed. Repetition is possessive
# wherever nothing could follow that it would have to give back, so that matching takes no stack and linear time; for
# the same reason a run of characters is tried from its start only.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "account", "secret")
CANDIDATE = (
    r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{2,6}(?:[ -][0-9]{2,6}){2,6}|[0-9]{9,34}"
    r"|(?:(?<![A-Za-z0-9_-])|\G)(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+"
)

# Word lists of the labelers, in the languages of the corpus.
PHONE_WORDS = "phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms|telefon|handy|mobil|anruf|rufnummer|móvil|teléfono|celular|llame|llamar|téléphone|portable|appelez"
ACCOUNT_WORDS = "card|visa|mastercard|amex|account|iban|bic|swift|konto|kontonummer|karte|cuenta|tarjeta|compte|carte|ssn|passport|reisepass|pasaporte|passeport|dni|nif|id"
SECRET_WORDS = "password|passwd|pwd|passwort|contraseña|token|secret|api|apikey|key|auth|bearer|credential|credentials|signature"
# Gazetteers of how numbers and keys of the kinds begin.
PHONE_STARTS = r"^(\(|0|1[ .-])"
ACCOUNT_STARTS = r"^(4|5[1-5]|34|35|36|37|6011|62|65)"
SECRET_STARTS = r"^(sk_|sk-|pk_|rk_|ghp_|gho_|ghs_|github_pat_|glpat-|xox|AKIA|ASIA|AIza|ya29|eyJ|npm_|hf_|SG)"
LABELERS = ("format", "list", "context", "edges")
#: Matches that are folded at once; a text's blocks are then put behind each other, so long texts take linear time.
BLOCK = 256


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once per row and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def in_blocks(values: Column) -> Column:
    """An array cut into arrays of ``BLOCK`` items; an empty array has no blocks."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(values, i, F.lit(BLOCK)))


def find_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, match, before, after), counted in code points.

    ``before`` is what precedes a match as far as the match before it, 24 characters at most; ``after`` is the character
    that follows.
    """
    empty = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        item = F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("match"), F.right(x["gap"], F.lit(24)).alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.when(x["match"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(item))).alias("found"))

    def placed(blocks: Column) -> Column:
        ends = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        moved = lambda b, at: F.transform(b["found"], lambda f: f.withField("start", f["start"] + at).withField("end", f["end"] + at))
        return _bind(ends, lambda e: F.flatten(F.transform(blocks, lambda b, i: moved(b, F.get(e, i)))))

    def walked(gaps: Column, matches: Column) -> Column:
        follow = F.transform(gaps, lambda g, i: F.substring(F.concat(F.coalesce(F.get(gaps, i + 1), F.lit("")), F.coalesce(F.get(matches, i + 1), F.lit(""))), 1, 1))
        pairs = F.arrays_zip(gaps.alias("gap"), matches.alias("match"), follow.alias("after"))
        blocks = F.transform(in_blocks(pairs), lambda b: F.aggregate(b, F.struct(F.lit(0).alias("at"), empty.alias("found")), step))
        return _bind(blocks, placed)

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
    return F.when(text.rlike(pattern), _bind(both, lambda x: walked(x["gaps"], x["matches"]))).otherwise(empty)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.substr(digits, -i, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    if kind == "card":
        return F.when(F.length(_digits(match)).between(12, 19), passes_luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


#: A cheap test that every text with a match of the kind passes.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]([\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}


def base_spans(text: Column, kind: str, pattern: str) -> Column:
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    number = F.lit(KINDS.index(kind))
    hint = text.contains(_HINTS[kind]) if kind == "email" else text.rlike(_HINTS[kind])
    good = F.filter(find_spans(text, pattern), lambda s: _valid(kind, s["match"]))
    return F.when(hint, F.transform(good, lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end")))).otherwise(none)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _judged(span: Column) -> Column:
    """Kind, votes and features of a candidate."""
    m, d = span["match"], _digits(span["match"])
    secret, local = m.rlike("[A-Za-z_]"), m.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$")
    phone = ~secret & (local | (m.rlike("[ .-]") & F.length(d).between(7, 11)))
    before, after = F.lower(span["before"]), span["after"]
    words = lambda w: before.rlike(rf"(?:^|[^\p{{L}}])(?:{w})[^\p{{L}}]*$")
    by_kind = lambda p, a, s: F.when(secret, s).when(phone, p).otherwise(a)
    own = by_kind(words(PHONE_WORDS), words(ACCOUNT_WORDS), words(SECRET_WORDS))
    other = words(f"{PHONE_WORDS}|{ACCOUNT_WORDS}|{SECRET_WORDS}")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[0-9]++", "0"), "[A-Za-z]++", "a"), "[^0a]", "")
    mixed = kinds.rlike("0a+0|a0+a")
    loose = (span["start"] == 0) | before.rlike(r"[\s(\"'=:]$")
    return F.struct(
        span["start"].alias("start"),
        span["end"].alias("end"),
        by_kind(F.lit(3), F.lit(4), F.lit(5)).alias("kind"),
        _vote(by_kind(local, F.length(d).between(13, 19), mixed), by_kind(F.lit(False), F.length(d) < 12, ~mixed)).alias("format"),
        _vote(by_kind(m.rlike(PHONE_STARTS), m.rlike(ACCOUNT_STARTS), m.rlike(SECRET_STARTS)), F.lit(False)).alias("list"),
        _vote(own, other).alias("context"),
        _vote(loose & ((after == "") | after.rlike(r"[\s.,;:!?)\"']")), after.rlike(r"[\p{L}\p{N}]")).alias("edges"),
        F.when(m.rlike("[ .()-]"), 1).otherwise(0).alias("grouped"),
        F.when(F.length(m) >= 20, 1).otherwise(0).alias("long"),
    )


def spans_and_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, candidates``: base spans in order, and judged candidates that overlap none of them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    found = F.concat(*(base_spans(text, k, p) for k, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))))
    rows = rows.withColumn("base", F.array_sort(found))
    # Blocks of base spans with their extent, so that a candidate is compared with few of them.
    blocks = F.transform(in_blocks(F.col("base")), lambda b: F.struct(F.array_min(F.transform(b, lambda s: s["start"])).alias("start"), F.array_max(F.transform(b, lambda s: s["end"])).alias("end"), b.alias("spans")))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    apart = lambda s, held: ~F.exists(held, lambda b: meets(b, s) & F.exists(b["spans"], lambda x: meets(x, s)))
    others = _bind(blocks, lambda held: F.transform(F.filter(find_spans(text, CANDIDATE), lambda s: apart(s, held)), _judged))
    hint = text.rlike("[0-9]")
    return rows.select("doc_id", "base", F.when(hint, others).alias("candidates"))


def reliabilities(patterns: list[dict], rounds: int = 50) -> tuple[dict[tuple, float], dict]:
    """Expectation-maximisation on counted vote patterns: posterior of each pattern, and the labelers' vote rates."""
    votes = [tuple(p[x] for x in LABELERS) for p in patterns]
    post = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v in votes]
    rates: dict = {}
    for _ in range(rounds):
        size = [sum(p["count"] * (q if y else 1 - q) for p, q in zip(patterns, post, strict=True)) for y in (0, 1)]
        for i, name in enumerate(LABELERS):
            for y in (0, 1):
                for v in (-1, 0, 1):
                    seen = sum(p["count"] * (q if y else 1 - q) for p, q, w in zip(patterns, post, votes, strict=True) if w[i] == v)
                    # The prior says that a vote is right more often than not.
                    rates[name, y, v] = (seen + (4 if v == (1 if y else -1) else 1)) / (size[y] + 6)
        prior = (size[1] + 1) / (sum(size) + 2)
        for k, v in enumerate(votes):
            odds = math.log(prior / (1 - prior)) + sum(math.log(rates[n, 1, v[i]] / rates[n, 0, v[i]]) for i, n in enumerate(LABELERS))
            post[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return dict(zip(votes, post, strict=True)), rates


FEATURES = (*LABELERS, "grouped", "long", "is_phone", "is_secret")


def _features(p: dict) -> list[float]:
    return [1.0, *(float(p[x]) for x in (*LABELERS, "grouped", "long")), float(p["kind"] == 3), float(p["kind"] == 5)]


def train_span_classifier(patterns: list[dict], rounds: int = 300) -> list[float]:
    """Logistic weights (bias first) from counted patterns, with the posteriors as soft labels."""
    post, _ = reliabilities(patterns)
    weights = [0.0] * (len(FEATURES) + 1)
    total = sum(p["count"] for p in patterns) or 1
    for _ in range(rounds):
        slope = [-0.001 * w for w in weights]
        for p in patterns:
            x = _features(p)
            z = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * v for w, v in zip(weights, x, strict=True))))))
            for i, v in enumerate(x):
                slope[i] += p["count"] / total * (post[tuple(p[n] for n in LABELERS)] - z) * v
        weights = [w + 2.0 * s for w, s in zip(weights, slope, strict=True)]
    return weights


def _accepted(span: Column, weights: list[float]) -> Column:
    values = [span[x] for x in (*LABELERS, "grouped", "long")] + [F.when(span["kind"] == k, 1).otherwise(0) for k in (3, 5)]
    return sum((w * v for w, v in zip(weights[1:], values, strict=True)), F.lit(weights[0])) > 0


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans``: sorted arrays of (start, kind number, end), code points, end exclusive.

    Null texts count as empty and have no spans. Base spans always stay; accepted candidates never overlap them.
    Repeated rows each get their row; extra columns are ignored; no rows give no rows.
    """
    found = stored(spans_and_candidates(docs, id_col, text_col), "pii-spans")
    keys = ["kind", *LABELERS, "grouped", "long"]
    each = found.select(F.explode("candidates").alias("c")).select(*(F.col(f"c.{k}").alias(k) for k in keys))
    patterns = [r.asDict() for r in each.groupBy(*keys).count().orderBy(*keys).collect()]  # 3 * 3**4 * 4 rows at most
    weights = train_span_classifier(patterns)
    more = F.transform(F.filter("candidates", lambda s: _accepted(s, weights)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce(more, F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
