"""Secret scans in column expressions: fixed patterns, and the entropy of sliding windows.

Matches and their places come from two functions that walk a text in the same way: the matches of a
pattern and the pieces between them; a place is the sum of the lengths before it.

Beside the patterns, every long stretch of key characters is a candidate.  A window slides over it; the
sum of n log n over the window's character counts n changes only by the counts of the character that leaves and the one
that enters, and gives the window's Shannon entropy.  Each character class has its own threshold.  Candidates
that the allow-list knows, and those that overlap a pattern's match, add nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import query, table, texts

#: In the order in which spans of the same start are listed.
KINDS = ("assign", "access", "hex", "entropy")

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The stretch of these two is the longest one, so that asking for its length in the pattern drops the same matches.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
#: (class, what a candidate of the class consists of, bits a window must reach); the first that fits holds.
CLASSES = (
    ("digits", r"^[0-9]+$", 2.6),
    ("hex", r"^[0-9a-fA-F]+$", 3.0),
    ("one case", r"^([a-z]+|[A-Z]+)$", 3.6),
    ("letters", r"^[A-Za-z]+$", 3.7),
    ("alphanumeric", r"^[A-Za-z0-9]+$", 3.7),
    ("base64", r"^.*$", 3.8),
)
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0123456789|1234567890|abcdefghij",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # identifiers of records, not keys
    # words joined by signs: paths, headings, rules; a word has one case, or humps of three letters and more
    r"^(?=[A-Za-z/_=+-]*$)(?=.*[/_=+-])(?!.*([a-z][A-Z](?![a-z]{2})|[A-Z]{2}[a-z]))",
    r"^([^A-Za-z0-9]*)$",
)

_SPANS = "array<struct<start:int,end:int,piece:string>>"


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once: a lambda's variable is."""
    return F.transform(F.array(value), use)[0]


def _placed(text: Column, matches: Column, pattern: str) -> Column:
    """(start, end, piece) of each match, in code points.

    Lengths are summed within blocks of about the root of the number of matches, then over the blocks.
    """
    pieces = F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)),
        matches,
        lambda before, match: F.struct(F.length(before).alias("skip"), match.alias("match")),
    )

    def step(done: Column, piece: Column) -> Column:
        start = done["at"] + piece["skip"]
        end = start + F.length(piece["match"])
        span = F.struct(start.alias("start"), end.alias("end"), piece["match"].alias("piece"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def in_blocks(pieces: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(pieces))).cast("int")
        starts = F.sequence(F.lit(1), F.size(pieces), width)
        return F.transform(starts, lambda i: F.aggregate(F.slice(pieces, i, width), zero, step))

    def moved(blocks: Column) -> Column:
        begins = F.aggregate(
            blocks,
            F.array(F.lit(0)),
            lambda done, block: F.concat(done, F.array(F.element_at(done, -1) + block["at"])),
        )
        return F.flatten(
            F.zip_with(
                blocks,
                F.slice(begins, F.lit(1), F.size(blocks)),
                lambda block, by: F.transform(
                    block["spans"],
                    lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["piece"].alias("piece")),
                ),
            )
        )

    placed = _bound(_bound(pieces, in_blocks), moved)
    return F.when(F.size(matches) > 0, placed).otherwise(F.array().cast(_SPANS))


def _nlogn(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def highest_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Bits of the window with the highest Shannon entropy; null for a candidate shorter than a window.

    For window counts n that sum to w, the entropy is log2(w) - sum(n log2 n) / w.  The counts of the candidate's
    characters are carried from window to window: one falls by one, one rises by one.
    """

    def of(letters: Column) -> Column:
        return _bound(F.array_distinct(letters), lambda kinds: slid(kinds, letters))

    def slid(kinds: Column, letters: Column) -> Column:
        codes = F.transform(letters, lambda x: F.array_position(kinds, x).cast("int"))
        return _bound(codes, lambda codes: least_of(kinds, codes))

    def least_of(kinds: Column, codes: Column) -> Column:
        first = F.slice(codes, 1, window)
        counts = F.transform(kinds, lambda _, k: F.size(F.filter(first, lambda x: x == k + 1)))
        return _bound(counts, lambda counts: bits(codes, counts))

    def bits(codes: Column, counts: Column) -> Column:
        start = F.aggregate(counts, F.lit(0.0), lambda s, n: s + _nlogn(n))

        def step(done: Column, i: Column) -> Column:
            gone, come = F.element_at(codes, i), F.element_at(codes, i + window)
            out, into = F.element_at(done["counts"], gone), F.element_at(done["counts"], come)
            now = done["now"] - _nlogn(out) + _nlogn(out - 1) - _nlogn(into) + _nlogn(into + 1)
            moved = F.transform(
                done["counts"], lambda n, k: n - (gone == k + 1).cast("int") + (come == k + 1).cast("int")
            )
            return F.when(gone == come, done).otherwise(
                F.struct(now.alias("now"), F.least(done["least"], now).alias("least"), moved.alias("counts"))
            )

        slides = F.when(F.size(codes) > window, F.sequence(F.lit(1), F.size(codes) - window)).otherwise(
            F.array().cast("array<int>")
        )
        zero = F.struct(start.alias("now"), start.alias("least"), counts.alias("counts"))
        least = F.aggregate(slides, zero, step, lambda done: done["least"])
        return F.when(F.size(codes) >= window, F.log2(F.lit(float(window))) - least / window)

    return _bound(F.split(candidate, ""), of)


def _secretive(piece: Column) -> Column:
    """Whether a candidate has a window above its class's threshold and is on no allow-list."""
    bits = F.lit(None).cast("double")
    for _, consists, least in reversed(CLASSES):
        bits = F.when(piece.rlike(consists), F.lit(least)).otherwise(bits)
    allowed = F.lit(False)
    for known in ALLOWED:
        allowed = allowed | piece.rlike(known)
    return F.when(allowed, F.lit(False)).otherwise(highest_entropy(piece) >= bits)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, assign, access, hex, entropy) for every row: arrays of (start, end, piece), by start.

    A null or empty text has none.  Rows with equal keys are scanned one by one; other columns are not read.
    """
    rows = texts(docs, key, text)
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    found = rows.select(
        key, text, *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_{k}") for k, p in patterns.items()]
    )
    placed = found.select(key, *[_placed(F.col(text), F.col(f"_{k}"), p).alias(k) for k, p in patterns.items()])
    kept = placed.withColumn(
        "assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s["piece"], ASSIGN, 2)) >= 6)
    )
    base = F.concat("assign", "access", "hex")
    alone = F.filter(
        "entropy",
        lambda c: ~F.exists(F.col("_base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    added = kept.withColumn("_base", base).withColumn("entropy", F.filter(alone, lambda c: _secretive(c["piece"])))
    return added.select(key, *KINDS)


def _listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind as listed."""

    def tagged(kind: str) -> Column:
        number = F.lit(KINDS.index(kind))
        return F.transform(
            kind, lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end"))
        )

    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            F.array_sort(F.concat(*map(tagged, kinds))),
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


@query("op2_secrets")
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_listed(KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        _listed(KINDS).alias("spans"),
    )
