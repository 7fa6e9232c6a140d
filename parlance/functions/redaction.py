"""Redaction of personal data and secrets: eight ordered rules, each a Column function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import AB, WS, bind

# Patterns and replacements, in the order in which they apply. Repetition that never has to give anything
# back is possessive, so that it takes no stack in Java; a run of characters is tried at its first word character only.
_RUN_START = "(?:(?<![A-Za-z0-9_][.%+-]{0,8})|\\G)"
EMAIL = f"(?i){_RUN_START}{AB}[A-Z0-9._%+-]++@[A-Z0-9.-]+\\.[A-Z]{{2,}}{AB}"
IBAN = f"{AB}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{2,4}}){{3,8}}{AB}"
CARD = f"{AB}(?:[0-9]{{13,19}}|[0-9]{{4}}([ -])[0-9]{{4}}\\1[0-9]{{4}}\\1[0-9]{{4}}(?:\\1[0-9]{{3}})?|[0-9]{{4}}([ -])[0-9]{{6}}\\2[0-9]{{5}}){AB}"
AWS_KEY = f"{AB}(?:AKIA|ASIA)[0-9A-Z]{{16}}{AB}"
TOKEN = f"{AB}(?:sk|rk|pk|xox[baprs]|ghp|github_pat)_[A-Za-z0-9_-]{{16,}}{AB}"
JWT = f"(?:(?<![A-Za-z0-9_]-{{0,8}})|\\G){AB}[A-Za-z0-9_-]{{32,}}+\\.[A-Za-z0-9_-]{{16,}}+\\.[A-Za-z0-9_-]{{16,}}{AB}"
ASSIGNMENT = f"(?i){AB}(api[_-]?key|token|secret|password){WS}*+[:=]{WS}*+[\"']?[^\"',;{WS[1:-1]}]{{8,}}+"
_SEPARATOR = "(?:[ ./-](?=[0-9])|\\) ?(?=[0-9])| ?\\((?=[0-9]))"
#: A run of digits that a letter follows isn't part of a number, but the separator before it is.
_DIGITS = "[0-9]++(?![A-Za-z_])"
PHONE = f"(?<=^|{WS}|\\()\\(?\\+?{_DIGITS}(?:{_SEPARATOR}{_DIGITS})*+{_SEPARATOR}?+"
#: Digits of a phone number at most, and groups that are walked at once.
MOST_DIGITS, BLOCK = 15, 256


def replace_matches(text: Column, pattern: str, replacement: Callable[[Column], Column]) -> Column:
    """Replace each match by an expression of it."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    piece = lambda x: F.concat(x["gap"], F.when(x["match"].isNull(), F.lit("")).otherwise(replacement(x["match"])))
    return F.array_join(F.transform(pairs, piece), "")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _iban(match: Column) -> Column:
    return F.when(F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34), F.lit("[redacted-iban]")).otherwise(match)


def _card(match: Column) -> Column:
    return F.when(luhn(_digits(match)), F.lit("[redacted-card]")).otherwise(match)


def looks_like_phone(v: Column) -> Column:
    digits = F.length(_digits(v))
    groups = F.filter(F.split(F.regexp_replace(v, "^(.*?)\\(0\\)", "$1"), "[ ./()-]+"), lambda g: g != "")
    return (
        digits.between(7, 15)
        & ~(v.rlike("^[0-9]+\\z") & ~v.startswith("0"))
        & ~v.rlike("^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}")
        & ~v.rlike("^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}\\z")
        & ~v.rlike(f"^[0-9]{{4}}{WS}*-{WS}*[0-9]{{4}}\\z")
        & ~(F.contains(v, F.lit(".")) & ~v.rlike("^[0-9]{3}\\.[0-9]{3}\\.[0-9]{4}\\z"))
        & ~v.rlike("^[1-9][0-9]{0,2}( [0-9]{3})+\\z")
        & ~F.exists(F.slice(groups, F.lit(2), F.greatest(F.size(groups), F.lit(1))), lambda g: F.length(g) == 1)
    )


def _phone(match: Column) -> Column:
    """The longest phone-like run of groups from each place on, left to right."""
    texts = F.array().cast("array<string>")

    def walk(groups: Column) -> Column:
        n = F.size(groups)

        def step(acc: Column, i: Column) -> Column:
            # Every group but the last holds a digit, so longer runs have too many of them.
            longest = F.least(n - i + 1, F.lit(MOST_DIGITS + 1))
            fits = F.filter(F.sequence(F.lit(1), longest), lambda k: looks_like_phone(F.array_join(F.slice(groups, i, k), " ")))
            take = F.when(acc["skip"] > 0, F.lit(None).cast("int")).otherwise(F.array_max(fits))
            more = F.when(acc["skip"] > 0, texts).when(take.isNull(), F.array(groups[i - 1])).otherwise(F.array(F.lit("[redacted-phone]")))
            skip = F.when(acc["skip"] > 0, acc["skip"] - 1).otherwise(F.coalesce(take - 1, F.lit(0)))
            return F.struct(skip.alias("skip"), F.concat(acc["out"], more).alias("out"))

        def block(acc: Column, first: Column) -> Column:
            own = F.sequence(first, F.least(n, first + BLOCK - 1))
            walked = F.aggregate(own, F.struct(acc["skip"].alias("skip"), texts.alias("out")), step)
            joined = lambda w: F.when(F.size(w["out"]) > 0, F.array(F.array_join(w["out"], " "))).otherwise(texts)
            return bind(walked, lambda w: F.struct(w["skip"].alias("skip"), F.concat(acc["out"], joined(w)).alias("out")))

        start = F.struct(F.lit(0).alias("skip"), texts.alias("out"))
        return F.array_join(F.aggregate(F.sequence(F.lit(1), n, F.lit(BLOCK)), start, block)["out"], " ")

    opened = match.startswith("(") & ~F.contains(match, F.lit(")"))
    body = F.when(opened, F.substr(match, F.lit(2))).otherwise(match)
    return F.concat(F.when(opened, F.lit("(")).otherwise(F.lit("")), bind(F.split(body, " "), walk))


def _if_hinted(c: Column, hint: str, rule: Callable[[Column], Column]) -> Column:
    """Apply a rule only to texts that pass a cheap test which every text with a match passes."""
    return bind(c, lambda t: F.when(t.rlike(hint), rule(t)).otherwise(t))


def redact_email(c: Column) -> Column:
    return _if_hinted(c, "@", lambda t: F.regexp_replace(t, EMAIL, "[redacted-email]"))


def redact_keys(c: Column) -> Column:
    """Cloud keys, provider tokens, signed tokens, then assignments."""
    c = _if_hinted(c, "A[KS]IA", lambda t: F.regexp_replace(t, AWS_KEY, "[redacted-aws-key]"))
    c = _if_hinted(c, "(?:sk|rk|pk|xox[baprs]|ghp|pat)_", lambda t: F.regexp_replace(t, TOKEN, "[redacted-token]"))
    c = _if_hinted(c, "[A-Za-z0-9_-]{16}\\.[A-Za-z0-9_-]{16}", lambda t: F.regexp_replace(t, JWT, "[redacted-token]"))
    return _if_hinted(c, f"(?i)(?:key|token|secret|password){WS}*+[:=]", lambda t: F.regexp_replace(t, ASSIGNMENT, "$1=[redacted-secret]"))


def redact_text(c: Column) -> Column:
    """All rules in order; null stays null."""
    c = _if_hinted(redact_email(c), "[A-Z]{2}[0-9]{2}", lambda t: replace_matches(t, IBAN, _iban))
    c = _if_hinted(c, "[0-9]{4}", lambda t: replace_matches(t, CARD, _card))
    return _if_hinted(redact_keys(c), "[0-9](?:[ ./()-]{0,2}[0-9]){6}", lambda t: replace_matches(t, PHONE, _phone))


def redact_block(b: Column) -> Column:
    """Text of text, code and quote blocks, Markdown of tables, alt text and file name of images."""
    fields = {"text": ("text", "code", "quote"), "markdown": ("table",), "alt": ("image",), "filename": ("image",)}
    # One array, so that the rules are compiled once and not for each field.
    values = F.array(*(F.when(b["type"].isin(*kinds), b[field]) for field, kinds in fields.items()))

    def put(redacted: Column) -> Column:
        out = b
        for i, (field, kinds) in enumerate(fields.items()):
            out = out.withField(field, F.when(b["type"].isin(*kinds), redacted[i]).otherwise(b[field]))
        return out

    return bind(F.transform(values, redact_text), put)
