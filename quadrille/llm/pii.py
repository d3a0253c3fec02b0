"""PII: regular expressions propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log2
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slices

#: In the order in which spans are listed. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "national_id", "secret")
BASE = KINDS[:4]
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.6, "national_id": 0.4, "secret": 0.4}
#: Words that make a kind likelier or less likely within REACH code points, and by how much: English, French, Spanish, German.
FOR = {
    "email": ("mail", "contact", "write", "courriel", "écri", "correo", "escrib", "kontakt", "schreib"),
    "ip": ("ip", "host", "server", "address", "adresse", "serveur", "dirección", "servidor", "rechner"),
    "card": ("card", "visa", "credit", "payment", "carte", "crédit", "paiement", "tarjeta", "pago", "karte", "zahlung"),
    "phone": ("phone", "call", "tel", "mobile", "tél", "appel", "llam", "móvil", "anruf", "handy"),
    "iban": ("iban", "bank", "account", "transfer", "banque", "compte", "virement", "banco", "cuenta", "konto", "überweis"),
    "national_id": ("identi", "passport", "security", "sécurité", "insee", "dni", "nif", "documento", "ausweis"),
    "secret": ("token", "key", "secret", "passw", "auth", "credential", "jeton", "clé", "mot de passe", "clave", "contraseña", "schlüssel", "geheim", "kennwort"),
}
AGAINST = {
    "email": ("example of", "exemple", "ejemplo", "beispiel"),
    "ip": ("version", "release", "section", "versión", "abschnitt"),
    "card": ("order", "serial", "invoice", "commande", "facture", "pedido", "factura", "bestell", "rechnung"),
    "phone": ("serial", "part no", "série", "serie", "seriennummer"),
    "iban": ("serial", "product", "produit", "producto", "produkt"),
    "national_id": ("serial", "order", "série", "serie", "bestell"),
    "secret": ("sha", "md5", "checksum", "digest", "commit", "revision"),
}
REACH, STEP = 40, 0.2
#: Spans of further kinds count from this score on; base kinds always do.
LEAST = 0.5

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# Each is written so that no text makes it run in more than linear time; none gives up digits that it has taken.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# Spain's number with its letter, France's with its key.
NATIONAL = re.compile(r"(?<![A-Za-z0-9])(?:[0-9]{8}-?[A-Z]|[12][0-9]{14})(?![A-Za-z0-9])")
#: The letter for each remainder by 23.
LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+=*+")
#: Bits of a secret's characters, at least.
ENTROPY = 3.0
_SEPARATORS = str.maketrans("", "", " -().+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 over the letters (A is 10) and digits of an account number."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def national(code: str) -> bool:
    """The letter is that of the remainder by 23; the key makes up the remainder by 97."""
    if code[-1].isdigit():
        return int(code[13:]) == 97 - int(code[:13]) % 97
    return LETTERS[int(code[:8]) % 23] == code[-1]


def looks_random(code: str) -> bool:
    """Letters and digits, mixed as no word is: ENTROPY bits a character or more."""
    counts = Counter(code)
    bits = -sum(n * log2(n / len(code)) for n in counts.values()) / len(code)
    return bits >= ENTROPY and any(c.isdigit() for c in code) and any(c.isalpha() for c in code)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ finds them, but from each @ outwards: the
    name is all that stands before it since the last span."""
    last, at = 0, text.find("@")
    while at >= 0:
        before = text[last:at]
        name = len(before) - len(before.rstrip(LOCAL))
        host = DOMAIN.match(text, at + 1) if name else None
        if host:
            yield at - name, host.end()
        last = host.end() if host else at + 1
        at = text.find("@", at + 1)


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - REACH) : start] + " " + text[end : end + REACH]).lower()
    return min(1.0, max(0.0, SCORES[kind] + STEP * any(w in near for w in FOR[kind]) - STEP * any(w in near for w in AGAINST[kind])))


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """Matches of IBAN that mod-97 confirms, each cut before a space where what follows isn't of the number: the
    longest that holds. What a match doesn't use is looked at again."""
    m = IBAN.search(text)
    while m:
        start, end = m.span()
        while end > start and not (IBAN.fullmatch(text, start, end) and mod97(text[start:end].replace(" ", ""))):
            end = text.rfind(" ", start, end)
        if end > start:
            yield start, end
        m = IBAN.search(text, end if end > start else start + 1)


def find_spans(text: str | None) -> list[Span]:
    """Spans of a whole text in code points, by kind, then start. Base kinds are found by their patterns
    alone, leftmost and without overlap per kind; of their matches that a check refuses nothing is tried again. A
    span of a further kind counts if its check confirms it (mod-97, mod-23, entropy), words nearby don't bring its score under
    LEAST, or bring it there, and no base span overlaps it."""
    if not text:
        return []
    found = [("email", s, e) for s, e in _emails(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].translate(_SEPARATORS)
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(m[0].translate(_SEPARATORS)) <= 15:
            found.append(("phone", m.start(), m.end()))
    spans = [Span(k, s, e, _score(text, k, s, e)) for k, s, e in found]
    further = [("iban", s, e) for s, e in _accounts(text)]
    further += [("national_id", m.start(), m.end()) for m in NATIONAL.finditer(text) if national(m[0])]
    further += [("secret", m.start(), m.end()) for m in SECRET.finditer(text) if looks_random(m[0])]
    taken = {k: ([s for kind, s, _ in found if kind == k], [e for kind, _, e in found if kind == k]) for k in BASE} if further else {}
    for kind, s, e in further:
        x = _score(text, kind, s, e)
        if x >= LEAST and not _overlaps(taken, s, e):
            spans.append(Span(kind, s, e, x))
    return spans


def _overlaps(taken: dict[str, tuple[list[int], list[int]]], start: int, end: int) -> bool:
    """Whether a base span reaches into this one. Those of one kind lie one after another, so the last that begins before
    the end decides."""
    for starts, ends in taken.values():
        k = bisect_right(starts, end - 1)
        if k and ends[k - 1] > start:
            return True
    return False


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, last = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= last:
            out += [text[last : s.start], f"[{s.kind.upper()}]"]
        last = max(last, s.end)
    return "".join([*out, text[last:]])


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row of docs (doc_id, text). No shuffle. A null or empty text has no
    spans; repeated rows each return."""
    entry = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[s._asdict() for s in find_spans(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(entry))], ["doc_id", "spans"])

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(f"spans {SPANS}").fields])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with the spans of `text` masked; all columns and rows stay, null texts too. No shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [x.as_py() for x in batch.column(at)]
            masked = [t and redact(t, find_spans(t)) for t in texts]
            yield batch.set_column(at, batch.schema.field(at).with_type(pa.string()), pa.array(masked, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(documents(spark, sf_dir, "doc_id", "text"))
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"), *map(count, KINDS[len(BASE) :]), F.transform(spans, lambda s: s["score"]).alias("scores"))
