"""Personal data in texts: patterns propose, checksums confirm, context scores; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEFORE, AFTER = 48, 24  # characters of context on either side
HELP, HARM = 0.25, 0.25  # what context adds or takes
LEAST_SCORE = 0.5  # of a span beyond the base kinds
RUN = 512  # matches whose places are summed up together


@dataclass(frozen=True)
class Kind:
    """What one kind of data looks like.

    ``quick`` is a cheap pattern without which a text has no match, ``holds`` says
    whether a match (text, before, after) is one, ``score`` is that of a match
    without context, ``help`` and ``harm`` are words that raise or lower it.
    """

    name: str
    base: bool
    quick: str
    pattern: str
    holds: Callable[[Column, Column, Column], Column]
    score: float
    help: str
    harm: str = ""


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _is_card(text: Column, before: Column, after: Column) -> Column:
    digits = _digits(text)
    return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)


def _is_phone(text: Column, before: Column, after: Column) -> Column:
    return F.length(_digits(text)).between(10, 15)


def mod97(iban: Column) -> Column:
    """The remainder of an IBAN without spaces: its head moved to the end, letters counting from 10."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        letter = (c >= "A") & (c <= "Z")
        return F.when(letter, rest * 100 + F.ascii(c) - 55).otherwise(rest * 10 + F.ascii(c) - 48) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _is_iban(text: Column, before: Column, after: Column) -> Column:
    plain = F.replace(text, F.lit(" "), F.lit(""))
    apart = ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]")
    return apart & F.length(plain).between(15, 34) & (mod97(plain) == 1)


def _is_ssn(text: Column, before: Column, after: Column) -> Column:
    apart = ~before.rlike("[0-9-]$") & ~after.rlike("^[0-9-]")
    return apart & ~text.rlike("^(000|666|9)|-00-|-0000$")


_IP = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# In the order in which spans at one place stand. Possessive quantifiers and
# the checks of where a run begins change no match, they spare the search of a
# long run from each of its places.
KINDS = (
    Kind("email", True, "@",
         r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda *_: F.lit(True), 0.75, "e-?mail|mail|contact|kontakt|correo|courriel"),
    Kind("ip", True, r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         lambda text, *_: text.rlike(rf"^{_IP}(?:\.{_IP}){{3}}$"), 0.5, "ip|host|server|address|adresse", "version|release"),
    Kind("card", True, "[0-9]", r"[0-9](?:[\x20-]?[0-9])++", _is_card, 0.625,
         "card|visa|mastercard|credit|karte|carte|tarjeta", "order|invoice|isbn|tracking"),
    Kind("phone", True, r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", _is_phone, 0.625,
         "phone|tel|call|fax|mobile|telefon|appel|llame"),
    Kind("iban", False, "[A-Z]{2}[0-9]{2}", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", _is_iban, 0.875,
         "iban|bank|account|konto|compte|cuenta"),
    Kind("ssn", False, "[0-9]-[0-9]{2}-[0-9]", "[0-9]{3}-[0-9]{2}-[0-9]{4}", _is_ssn, 0.375,
         "ssn|social|security|taxpayer"),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(steps: Column) -> Column:
    """For each step the sum of those before it; runs of RUN are summed apart, so a long list costs little more than its length."""

    def along(of: Column, start: Column) -> Column:
        first = F.struct(F.expr("cast(array() as array<bigint>)").alias("sums"), start.cast("long").alias("at"))
        return F.aggregate(
            of, first,
            lambda so, x: F.struct(F.array_append(so["sums"], so["at"]).alias("sums"), (so["at"] + x).alias("at")),
            lambda so: so["sums"],
        )

    def whole(steps: Column) -> Column:
        ends = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN))
        return _let(
            F.transform(ends, lambda i: F.slice(steps, (i * RUN + 1).cast("int"), F.lit(RUN))),
            lambda runs: F.flatten(
                F.zip_with(
                    runs,
                    along(F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)),
                    along,
                )
            ),
        )

    return F.when(F.size(steps) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(_let(steps, whole))


def _has(words: str, before: Column, after: Column) -> Column:
    word = f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)"
    return F.lower(before).rlike(word) | F.lower(after).rlike(word)


def _spans(text: Column, place: int, kind: Kind) -> Column:
    """The confirmed matches of one kind: structs of start, order, kind, end, text, score, base.

    The text is cut at its matches; lengths of the pieces and of the matches
    sum up to places, and the pieces beside a match are its context.
    """

    def cut(parts: Column) -> Column:
        found, pieces = parts["found"], parts["pieces"]
        steps = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda m, p: (F.length(m) + F.length(p)).cast("long"))
        return F.zip_with(
            F.sequence(F.lit(0), F.size(found) - 1), _running(steps),
            lambda i, at: F.struct(
                F.get(found, i).alias("text"),
                (at + F.length(F.get(pieces, i))).alias("start"),
                F.right(F.get(pieces, i), F.lit(BEFORE)).alias("before"),
                F.left(F.get(pieces, i + 1), F.lit(AFTER)).alias("after"),
            ),
        )

    def scored(m: Column) -> Column:
        score = F.lit(kind.score) + F.when(_has(kind.help, m["before"], m["after"]), HELP).otherwise(0.0)
        if kind.harm:
            score = score - F.when(_has(kind.harm, m["before"], m["after"]), HARM).otherwise(0.0)
        return F.struct(
            m["start"].alias("start"), F.lit(place).alias("order"), F.lit(kind.name).alias("kind"),
            (m["start"] + F.length(m["text"])).alias("end"), m["text"].alias("text"),
            score.alias("score"), F.lit(kind.base).alias("base"),
        )

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"),
        F.split(text, kind.pattern, -1).alias("pieces"),
    )
    matches = _let(parts, lambda parts: F.when(F.size(parts["found"]) > 0, cut(parts)))
    held = F.filter(matches, lambda m: kind.holds(m["text"], m["before"], m["after"]))
    spans = F.transform(held, scored)
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)
    return F.coalesce(F.when(text.rlike(kind.quick), spans), F.expr(f"cast(array() as {_SPANS})"))


_SPANS = "array<struct<start: bigint, order: int, kind: string, end: bigint, text: string, score: double, base: boolean>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans) of every row: personal data with its place, in code points, and a score from 0 to 1.

    Spans are structs of start, order, kind, end (exclusive), text, score and
    base, sorted by start, then by the order of KINDS. Of each kind the
    leftmost matches that don't overlap are proposed; one that fails its check
    is dropped without another try. Addresses of the network have parts up to
    255, card numbers pass Luhn's check, telephone numbers have 10 to 15
    digits. IBANs are confirmed modulo 97; American social security numbers
    have no checksum and only context words lift them over LEAST_SCORE. Spans
    of the base kinds stay whatever their score; spans of different kinds may
    overlap.

    A null text counts as empty and has no spans; repeated rows each return a
    row, null ids too; other columns are ignored; an empty table gives no
    rows. Texts of any length are searched whole, row by row, so nothing is
    shuffled and no row depends on another.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    found = [_spans(F.col("text"), i, kind) for i, kind in enumerate(KINDS)]
    return rows.select("doc_id", "text", F.sort_array(F.concat(*found)).alias("spans"))


def listed(spans: Column) -> Column:
    """'kind:start:end' of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping ones the first in order counts."""
    empty = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))

    def step(so: Column, s: Column) -> Column:
        gap = F.substring(text, (so["at"] + 1).cast("int"), (s["start"] - so["at"]).cast("int"))
        return F.when(
            s["start"] >= so["at"],
            F.struct(F.concat(so["kept"], gap, F.lit("<"), s["kind"], F.lit(">")).alias("kept"), s["end"].alias("at")),
        ).otherwise(F.struct(so["kept"].alias("kept"), F.greatest(so["at"], s["end"]).alias("at")))

    def rest(so: Column) -> Column:
        return F.concat(so["kept"], F.substring(text, (so["at"] + 1).cast("int"), F.length(text)))

    return F.aggregate(spans, empty, step, rest)


SQL = r"""
WITH RECURSIVE kinds(place, kind, pattern) AS (VALUES
    (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'),
    (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
    (2, 'card', '[0-9]([\x20-]?[0-9])+'),
    (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'),
    (4, 'iban', '[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?'),
    (5, 'ssn', '[0-9]{3}-[0-9]{2}-[0-9]{4}')
), powers(k, w) AS (
    SELECT 0, 1 UNION ALL SELECT k + 1, w * 10 % 97 FROM powers WHERE k < 80
), texts AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), parts AS (
    SELECT row, place, kind, regexp_extract_all(text, pattern) AS found, string_split_regex(text, pattern) AS pieces
    FROM texts, kinds
), matches AS (
    SELECT row, place, kind, i, found[i] AS m, right(pieces[i], 48) AS before, left(pieces[i + 1], 24) AS after,
           length(pieces[i]) AS gap
    FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM parts WHERE len(found) > 0)
), placed AS (
    SELECT *, CAST(sum(gap + length(m)) OVER (PARTITION BY row, place ORDER BY i) - length(m) AS BIGINT) AS start,
           regexp_replace(m, '[^0-9]', '', 'g') AS digits
    FROM matches
), ibans AS (
    SELECT row, i, array_to_string([CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END
                                    for c in string_split(substr(p, 5) || substr(p, 1, 4), '')], '') AS number
    FROM (SELECT row, i, replace(m, ' ', '') AS p FROM placed
          WHERE kind = 'iban' AND NOT regexp_matches(before, '[A-Za-z0-9]$') AND NOT regexp_matches(after, '^[A-Za-z0-9]'))
    WHERE length(p) BETWEEN 15 AND 34
), confirmed AS (
    SELECT row, i FROM (SELECT row, i, number, unnest(range(0, length(number))) AS k FROM ibans)
    JOIN powers USING (k)
    GROUP BY row, i HAVING sum(CAST(number[length(number) - k] AS INTEGER) * w) % 97 = 1
), held AS (
    SELECT p.*, place < 4 AS base FROM placed p LEFT JOIN confirmed c ON p.kind = 'iban' AND p.row = c.row AND p.i = c.i
    WHERE CASE kind
        WHEN 'email' THEN true
        WHEN 'ip' THEN len([x for x in string_split(m, '.') if length(ltrim(x, '0')) > 3
                            OR CAST('0' || left(ltrim(x, '0'), 3) AS INTEGER) > 255]) = 0
        WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum([
                CASE WHEN (length(digits) - k) % 2 = 0 THEN CAST(digits[k] AS INTEGER)
                     ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(digits[k] AS INTEGER) + 1] END
                for k in range(1, length(digits) + 1)]) % 10 = 0
        WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
        WHEN 'iban' THEN c.row IS NOT NULL
        ELSE NOT regexp_matches(before, '[0-9-]$') AND NOT regexp_matches(after, '^[0-9-]')
            AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')
            AND (regexp_matches(lower(before), '(^|[^a-z])(ssn|social|security|taxpayer)([^a-z]|$)')
                 OR regexp_matches(lower(after), '(^|[^a-z])(ssn|social|security|taxpayer)([^a-z]|$)'))
        END
), named AS (
    SELECT *, kind || ':' || start || ':' || (start + length(m)) AS span FROM held
), summed AS (
    SELECT row, count_if(kind = 'email') AS n_email, count_if(kind = 'ip') AS n_ip, count_if(kind = 'card') AS n_card,
           count_if(kind = 'phone') AS n_phone, string_agg(span, ',' ORDER BY start, place) FILTER (base) AS base,
           string_agg(span, ',' ORDER BY start, place) AS spans
    FROM named GROUP BY row
)
SELECT doc_id, CAST(coalesce(n_email, 0) AS BIGINT) AS n_email, CAST(coalesce(n_ip, 0) AS BIGINT) AS n_ip,
       CAST(coalesce(n_card, 0) AS BIGINT) AS n_card, CAST(coalesce(n_phone, 0) AS BIGINT) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN summed USING (row)
"""
