"""Sensitive-data detectors: pattern findings with checks, overlap resolution and redaction.

Patterns run as one pandas UDF over whole texts; a finding holds a location, never the value. Cards
and national ids are checked by digit sums that are also offered as column expressions.
"""

from __future__ import annotations

import ipaddress
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lexiloom.session import table

#: Classes in the order in which they win overlaps, with their placeholders.
CLASSES = ("api_secret", "payment_card", "government_id", "email", "ip_address", "phone")
PLACEHOLDERS = {c: f"[{c.upper()}]" for c in CLASSES}
#: Fixed patterns: (class, detector, pattern, group).
PATTERNS = (
    ("email", "email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9.!#$%&'*+/=?^_`{|}~\-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}(?![A-Za-z0-9_\-])", 0),
    ("payment_card", "luhn", r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)", 0),
    ("government_id", "us_ssn", r"(?<!\d)(?!000|666|9\d\d)\d{3}[- ](?!00)\d{2}[- ](?!0000)\d{4}(?!\d)", 0),
    ("government_id", "aadhaar", r"(?<!\d)\d{4}[ -]\d{4}[ -]\d{4}(?!\d)", 0),
    ("ip_address", "ipv4", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.])", 0),
    ("ip_address", "ipv6", r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])", 0),
    ("phone", "phone", r"(?<![\w\d])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-](?:\d{2,4}[ .-]){1,3}\d{2,4}(?![\w\d])", 0),
    ("api_secret", "openai_key", r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{16,}(?![A-Za-z0-9])", 0),
    ("api_secret", "aws_access_key", r"(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])", 0),
    ("api_secret", "github_token", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{20,}(?![A-Za-z0-9])", 0),
    ("api_secret", "slack_token", r"(?<![A-Za-z0-9])xox[baprs]-[A-Za-z0-9-]{16,}(?![A-Za-z0-9])", 0),
    ("api_secret", "assigned_secret", r"(?i)(?:api[_-]?key|access[_-]?token|secret|password)\s*[:=]\s*[\"']?([A-Za-z0-9_./+=-]{7,}[A-Za-z0-9_+=])", 1),
)
#: Detectors whose matches hold digits and these signs only, and the runs that such matches lie within.
NUMERIC = ("luhn", "us_ssn", "aadhaar", "ipv4", "phone")
_NUMBERS = re.compile(r"[+(]{0,2}\d[\d .()+\-]{5,}")
#: What a text must hold for other detectors to match.
_SIGNS = {"email": ("@",), "openai_key": ("sk-",), "aws_access_key": ("AKIA",), "github_token": tuple(f"gh{c}_" for c in "pousr"), "slack_token": ("xox",)}
_COMPILED = tuple((c, d, re.compile(p), g) for c, d, p, g in PATTERNS)


def luhn_valid(digits: Column) -> Column:
    """True for a string of digits whose Luhn sum is a multiple of ten."""
    array = F.reverse(F.transform(F.split(digits, ""), lambda c: c.cast("int")))
    doubled = F.transform(array, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _dihedral(a: int, b: int) -> int:
    """The group of the pentagon's ten symmetries: rotations 0 to 4, reflections 5 to 9."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def _verhoeff_tables() -> tuple[list[list[int]], list[list[int]]]:
    """The multiplication table and the powers of the permutation (1 5 8 9 4 2 7 0)(3 6)."""
    step = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    powers = [list(range(10))]
    for _ in range(7):
        powers.append([step[x] for x in powers[-1]])
    return [[_dihedral(a, b) for b in range(10)] for a in range(10)], powers


MULTIPLY, PERMUTE = _verhoeff_tables()


def verhoeff_valid(digits: Column) -> Column:
    """True for a string of digits whose Verhoeff sum is zero."""
    flat = lambda rows: F.array(*[F.lit(x) for row in rows for x in row])
    array = F.reverse(F.transform(F.split(digits, ""), lambda c: c.cast("int")))
    placed = F.transform(array, lambda d, i: F.get(flat(PERMUTE), (i % 8) * 10 + d))
    return F.aggregate(placed, F.lit(0), lambda a, d: F.get(flat(MULTIPLY), a * 10 + d)) == 0


def _check(detector: str, value: str) -> bool:
    if detector == "luhn":
        digits = [int(c) for c in value if c.isdigit()][::-1]
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    if detector == "aadhaar":
        total = 0
        for i, c in enumerate(reversed([c for c in value if c.isdigit()])):
            total = MULTIPLY[total][PERMUTE[i % 8][int(c)]]
        return total == 0
    if detector in ("ipv4", "ipv6"):
        try:
            ipaddress.ip_address(value)
        except ValueError:
            return False
    return True


def _may_hold(detector: str, text: str) -> bool:
    """A quick look that never says no to a text with a match."""
    if detector in _SIGNS:
        return any(sign in text for sign in _SIGNS[detector])
    if detector == "ipv6":
        return text.count(":") > 1
    if detector == "assigned_secret":  # the long s folds to s, but lower() leaves it
        return ("=" in text or ":" in text) and ("\u017f" in text or any(w in low for low in (text.lower(),) for w in ("key", "token", "secret", "password")))
    return True


def findings(text: str, classes=CLASSES) -> list[tuple[int, int, str, str]]:
    """(start, end, class, detector) in order: of overlapping matches the earliest, then by class order, length and detector."""
    found, runs = [], None
    for cls, detector, pattern, group in _COMPILED:
        if cls not in classes or not _may_hold(detector, text):
            continue
        if detector in NUMERIC:
            runs = [(m.start(), m.end()) for m in _NUMBERS.finditer(text)] if runs is None else runs
            matches = (m for s, e in runs for m in pattern.finditer(text, s, e + 1))
        else:
            matches = pattern.finditer(text)
        found += [(*m.span(group), cls, detector) for m in matches if _check(detector, m[group])]
    found.sort(key=lambda f: (f[0], CLASSES.index(f[2]), f[0] - f[1], f[3]))
    out, past = [], 0
    for f in found:
        if f[0] >= past:
            out.append(f)
            past = f[1]
    return out


#: Texts whose findings are handed on together: besides its batch of texts, a task holds what was made of so many.
TEXTS = 256


def _redacted(batches, classes, actions):
    """Batches of TEXTS rows at most, with the redacted text in place of the text, and its findings."""
    for batch in batches:
        where = batch.schema.get_field_index("text")
        for at in range(0, batch.num_rows, TEXTS):
            part, texts, all_found = batch.slice(at, TEXTS), [], []
            for text in part.column(where).to_pylist():
                text = text or ""
                out, past, found = [], 0, findings(text, classes)
                for s, e, cls, _ in found:
                    if actions.get(cls, "redact") == "redact":
                        out += [text[past:s], PLACEHOLDERS[cls]]
                        past = e
                texts.append("".join([*out, text[past:]]))
                all_found.append([dict(zip(_FINDING.names, f, strict=True)) for f in found])
            columns = [pa.array(texts, pa.string()) if k == where else c for k, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(all_found, pa.list_(_FINDING))], names=[*part.schema.names, "findings"])


_FINDING = pa.struct([("start_char", pa.int32()), ("end_char", pa.int32()), ("entity_class", pa.string()), ("detector", pa.string())])
_SPARK_FINDING = StructType([StructField("start_char", IntegerType()), StructField("end_char", IntegerType()), StructField("entity_class", StringType()), StructField("detector", StringType())])


def redact(docs: DataFrame, classes=CLASSES, actions=None) -> DataFrame:
    """Text with placeholders, findings, and whether a ``drop_document`` action dropped the document."""
    actions = actions or {}
    dropping = [c for c, a in actions.items() if a == "drop_document"]
    schema = StructType([*docs.schema.fields, StructField("findings", ArrayType(_SPARK_FINDING))])
    found = docs.mapInArrow(lambda batches: _redacted(batches, classes, actions), schema)
    return found.withColumn("dropped", F.exists("findings", lambda f: f["entity_class"].isin(*dropping)) if dropping else F.lit(False))


def q_findings(spark, sf):
    found = redact(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.posexplode("findings").alias("nth", "f")).select("doc_id", "nth", "f.start_char", "f.end_char", "f.entity_class", "f.detector")


def q_by_class(spark, sf):
    return q_findings(spark, sf).groupBy("entity_class", "detector").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("doc_id").alias("documents"))


def q_redacted(spark, sf):
    found = redact(table(spark, sf, "documents").select("doc_id", "text"), actions={"payment_card": "drop_document"})
    return found.where(~F.col("dropped")).select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.size("findings").alias("findings"))


def _runs(spark, sf, low: int, high: int):
    """Runs of digits bounded by other characters, without separators."""
    runs = F.regexp_extract_all("text", F.lit(r"([0-9]+)"), 1)
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(runs).alias("nth", "digits"))
    return docs.where(F.length("digits").between(low, high))


def q_luhn(spark, sf):
    return _runs(spark, sf, 13, 19).select("doc_id", "nth", luhn_valid(F.col("digits")).alias("valid"))


def q_verhoeff(spark, sf):
    """The checksum of the last twelve digits of long runs."""
    return _runs(spark, sf, 12, 19).select("doc_id", "nth", verhoeff_valid(F.expr("right(digits, 12)")).alias("valid"))


def q_ipv4(spark, sf):
    """Dotted quads between spaces whose parts are 0 to 255 without leading zeros."""
    word = F.explode(F.split(F.regexp_replace("text", r"[\s]+", " "), " ")).alias("w")
    part = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return table(spark, sf, "documents").select("doc_id", word).where(F.col("w").rlike(rf"^{part}\.{part}\.{part}\.{part}$")).select("doc_id", F.col("w").alias("address"))


_RUNS = "(SELECT doc_id, generate_subscripts(l, 1) - 1 AS nth, unnest(l) AS digits FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS l FROM documents))"
_PART = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

QUERIES = {
    "pii_findings": (q_findings, None),
    "pii_findings_by_class": (q_by_class, None),
    "pii_redacted_documents": (q_redacted, None),
    "luhn_valid_cards": (
        q_luhn,
        f"""SELECT doc_id, nth, (SELECT sum(CASE WHEN i % 2 = 0 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END) FROM (SELECT unnest(range(length(digits))) AS i, CAST(unnest(string_split(reverse(digits), '')) AS INT) AS d)) % 10 = 0 AS valid
        FROM {_RUNS} WHERE length(digits) BETWEEN 13 AND 19""",
    ),
    "verhoeff_valid_ids": (
        q_verhoeff,
        f"""SELECT doc_id, nth, list_reduce(list_prepend(0, [({PERMUTE})[1 + (i - 1) % 8][1 + CAST(substr(reverse(right(digits, 12)), CAST(i AS BIGINT), 1) AS INT)] FOR i IN range(1, 13)]),
        lambda a, d: ({MULTIPLY})[1 + a][1 + d]) = 0 AS valid FROM {_RUNS} WHERE length(digits) BETWEEN 12 AND 19""",
    ),
    "ipv4_addresses": (
        q_ipv4,
        f"""SELECT doc_id, w AS address FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS w FROM documents)
        WHERE regexp_full_match(w, '{_PART}\\.{_PART}\\.{_PART}\\.{_PART}')""",
    ),
}
