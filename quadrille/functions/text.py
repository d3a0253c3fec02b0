"""Text expressions: fields, labels, prompts and judge responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields that a source may hold, in order of preference.
TEXT_FIELDS = ("text", "sentence", "query", "utterance")
LABEL_FIELDS = ("intent", "label", "category")
#: Labels that mean out of scope.
OUT_OF_SCOPE = ("oos", "out_of_scope")
CACHE_VERSION = 1


def infer_field(columns: Sequence[str], candidates: Sequence[str]) -> str:
    for name in candidates:
        if name in columns:
            return name
    raise ValueError(f"none of {', '.join(candidates)} is a column")


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def join_fields(*fields: Column) -> Column:
    """The fields that aren't null or blank, stripped, with an empty line between; none: an empty text."""
    parts = F.transform(F.array(*[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), strip)
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")


def normalize_label(label: Column) -> Column:
    return F.translate(F.translate(strip(F.lower(label)), "-", "_"), " ", "_")


def label_name(label: Column, names: Sequence[str]) -> Column:
    """The name of a numbered label, or the label itself as text."""
    number = label.cast("string").try_cast("int")
    known = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return F.when((number >= 0) & (number < len(names)), F.try_element_at(known, number + 1)).otherwise(label.cast("string"))


def _quoted(text: Column) -> Column:
    """text as a JSON string, characters outside ASCII as they are."""
    whole = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("x")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def cache_key(a: Column, b: Column, c: Column, d: Column) -> Column:
    """JSON of a comparison in which each pair is in order; the two pairs keep their places."""
    pairs = zip("abcd", (F.least(a, b), F.greatest(a, b), F.least(c, d), F.greatest(c, d)))
    parts = [F.concat(F.lit(f'"{k}": '), _quoted(x)) for k, x in pairs]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts, F.lit(f'"version": {CACHE_VERSION}')), F.lit("}"))


def prompt(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Messages that ask a chat model to compare two pairs."""
    system = "You judge which of two pairs of texts is closer in meaning. Answer with one JSON object."
    user = F.concat(*[x for k, t in zip("ABCD", (a, b, c, d)) for x in (F.lit(f"Text {k}: "), t, F.lit("\n"))], F.lit('Is the distance between A and B smaller than that between C and D? Fields: "reasoning" (string), "is_ab_less_than_cd" (boolean).'))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def parse_response(response: Column) -> Column:
    """struct(ok, reasoning, answer) of a judge's reply: the object from the first brace on, whatever stands
    around it. Both fields must be there with their own types, or ok is false."""
    body = F.substring(response, F.greatest(F.instr(response, "{"), F.lit(1)), F.length(response))
    fields = F.from_json(body, "reasoning variant, is_ab_less_than_cd variant")
    said, flag = fields["reasoning"], fields["is_ab_less_than_cd"]
    ok = F.coalesce((F.schema_of_variant(said) == "STRING") & (F.schema_of_variant(flag) == "BOOLEAN"), F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, F.try_variant_get(said, "$", "string")).alias("reasoning"), F.when(ok, F.try_variant_get(flag, "$", "boolean")).alias("answer"))


def six_digits(x: Column) -> Column:
    """A number with six significant digits, without zeros at the end; with an exponent below 0.0001 and from a million on."""
    written = F.format_string("%.5e", F.abs(x))
    digits = F.concat(F.substring(written, 1, 1), F.substring(written, 3, 5))
    e = F.regexp_extract(written, r"e([+-]\d+)$", 1).cast("int")
    zeros = F.repeat(F.lit("0"), F.greatest(-e - 1, F.lit(0)))
    whole = F.when(e >= 0, F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, F.lit(6)))).otherwise(F.concat(F.lit("0."), zeros, digits))
    power = F.concat(F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    far = F.concat(_plain(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5))), F.when(F.abs(e) > 99, F.concat(F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.abs(e).cast("string"))).otherwise(power))
    text = F.when(x == 0, "0").when((e < -4) | (e >= 6), far).otherwise(_plain(whole))
    return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), text))


def _plain(number: Column) -> Column:
    """Without zeros and a point at the end."""
    return F.regexp_replace(number, r"\.?0*$", "")
