"""Personal data: regular expressions propose spans, checksums confirm them, context words set the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

# The base kinds in the order in which equal starts are listed, then the added ones.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write", "reply"),
    "ip": ("ip", "host", "server", "address", "addr", "login"),
    "card": ("card", "visa", "credit", "debit", "payment", "mastercard"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "compte"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
#: What a confirmed span scores before and after context, and how far context reaches in code points.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT_BONUS, CONTEXT_REACH = 0.3, 48
#: Added kinds need this score to count; base kinds always stay.
MIN_ADDED_SCORE = 0.5

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these starts where its digit run starts, so possessive runs keep the scan linear and the leftmost match the same.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Characters of an IBAN by country, as registered.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
WORD = re.compile(r"[a-z-]+")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if place % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain, found from each @ so that long runs stay linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Confirmed IBANs: of each proposal its country's length where that ends a group, else all of it. What a proposal took beyond that is looked at again."""
    m = IBAN.search(text)
    while m:
        ends, places = [m.end()], [i for i in range(m.start(), m.end()) if text[i] != " "]
        n = IBAN_LENGTHS.get(m[0][:2], 0)
        if 0 < n < len(places) and text[places[n - 1] + 1] == " ":
            ends.insert(0, places[n - 1] + 1)
        for end in ends:
            if 15 <= len(code := text[m.start() : end].replace(" ", "")) <= 34 and mod97(code):
                yield m.start(), end
                break
        else:
            end = m.start() + 4
        m = IBAN.search(text, end)


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All confirmed spans of the base kinds and proposals of the added kinds that their checksum confirms."""
    found = [("email", *x) for x in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    found += [("iban", *x) for x in ibans(text)]
    found += [("ssn", *m.span()) for m in SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    return found


def scored(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    """The spans that count, by start and kind, each with the score that nearby words give it."""
    out = []
    for kind, start, end in spans:
        near = WORD.findall(f"{text[max(0, start - CONTEXT_REACH) : start]} {text[end : end + CONTEXT_REACH]}".lower())
        score = min(1.0, BASE_SCORE[kind] + CONTEXT_BONUS * any(w in CONTEXT[kind] for w in near))
        if kind in BASE_KINDS or score >= MIN_ADDED_SCORE:
            out.append((kind, start, end, score))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each stretch of overlapping spans replaced by <KIND> of the first of them."""
    out, done, last = [], 0, -1
    for kind, start, end, _ in spans:
        if start >= last:
            out += [text[done:start], f"<{kind.upper()}>"]
            last = end
        last = done = max(last, end)
    out.append(text[done:])
    return "".join(out)


def joined(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


SCAN = "struct<kinds:array<string>,starts:array<long>,ends:array<long>,scores:array<double>,masked:string,spans:string>"
DIGEST = "struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string,scores:array<double>>"


def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        spans = scored(text, found) if (found := spans_of(text)) else []
        rows.append(([s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans], [s[3] for s in spans], masked(text, spans) if spans else None, joined(spans)))
    return pd.DataFrame(rows, columns=["kinds", "starts", "ends", "scores", "masked", "spans"])


def _digest(texts: pd.Series) -> pd.DataFrame:
    empty = hashlib.sha256(b"").hexdigest()
    rows = []
    for text in texts:
        if not (found := spans_of(text)):
            rows.append((0, 0, 0, 0, empty, "", []))
            continue
        spans = scored(text, found)
        base = [s for s in spans if s[0] in BASE_KINDS]
        kinds = [s[0] for s in base]
        rows.append((*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), [s[3] for s in spans]))
    return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])


def find_pii(docs: DataFrame) -> DataFrame:
    """Add ``pii``: kinds, starts, ends (code points, end exclusive), scores, spans as text.

    Null texts count as empty and have no spans. Repeated rows give repeated results.
    Spans of equal start are ordered by kind. Texts of any length are read whole, in
    linear time. An empty table stays empty. A column of docs named ``pii`` is replaced.
    """
    return docs.withColumn("pii", F.pandas_udf(_scan, SCAN)(whole_text())).withColumn("pii", F.col("pii").dropFields("masked"))


def mask_pii(docs: DataFrame) -> DataFrame:
    """Replace each span by its kind in angle brackets, overlapping ones by the first's; n_chars follows.

    Texts without spans (null and empty ones too) stay as they are. Repeated rows give
    repeated results, an empty table stays empty, all other columns stay, whatever their names.
    """
    rows = docs.select(F.struct("*").alias("row"), F.pandas_udf(_scan, SCAN)(whole_text()).alias("pii"))
    masked_text = F.col("pii.masked")
    out = {c: F.col("row").getField(c) for c in docs.columns}
    out["text"] = F.coalesce(masked_text, out["text"])
    if "n_chars" in out:
        out["n_chars"] = F.when(masked_text.isNotNull(), F.char_length(masked_text).cast(dict(docs.dtypes)["n_chars"])).otherwise(out["n_chars"])
    return rows.select(*[c.alias(name) for name, c in out.items()])


def pii_digests(docs: DataFrame) -> DataFrame:
    """Counts and digests of the base spans of each document, and all spans; cases as in ``find_pii``, other columns are dropped, a null doc_id stays null."""
    return docs.select("doc_id", F.pandas_udf(_digest, DIGEST)(whole_text()).alias("d")).select("doc_id", "d.*")
