"""Secret scan: three rules, and character Markov models for what rules miss.

The rules give the base spans. Strings that follow none of them are judged by
two Markov models of characters, one of random strings and one of ordinary
identifiers, trained from labelled samples; a string whose log-likelihood ratio
is high enough is a further span. Only DataFrame functions run.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, each with the condition a match must meet.
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a shorter run holds no match, so the bound may stand in the pattern
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
SYMBOLS = len(ALPHABET) + 1  # index 0: any other character
MIN_LENGTH = 16
FULL_LENGTH = 20  # shorter strings must bring as much evidence as one of this length
_RUN = "[A-Za-z0-9+/_-]"
CANDIDATE = _RUN + "{%d,}" % MIN_LENGTH
# Runs too short for the pattern above, or not random enough alone, joined by separators. A match
# starts where a run starts, so that a long run without separators is passed once.
BROKEN = f"(?<!{_RUN}){_RUN}{{6,}}+(?:[.=~]++{_RUN}{{6,}}+)++"
_BLOCK = 256


@dataclass(frozen=True)
class Markov:
    """Log-likelihood ratio of each transition; ``table`` is empty without samples."""

    table: tuple[float, ...]

    def ratio(self, text: Column) -> Column:
        """Mean log-likelihood ratio per transition; above 0: more like random strings."""
        if not self.table:
            return F.lit(float("-inf"))
        # A literal that the optimizer folds into one constant array.
        weights = F.split(F.lit(",".join(repr(w) for w in self.table)), ",").cast("array<double>")
        steps = F.zip_with(
            F.filter(F.split(text, ""), lambda c: c != ""),
            F.filter(F.split(F.substring(text, 2, 1 << 30), ""), lambda c: c != ""),
            lambda a, b: F.when(b.isNull(), 0.0).otherwise(F.get(
                weights, F.instr(F.lit(ALPHABET), a) * SYMBOLS + F.instr(F.lit(ALPHABET), b))))
        return (F.aggregate(steps, F.lit(0.0), lambda x, y: x + y)
                / F.greatest(F.length(text) - 1, F.lit(1)))


    def suspects(self, threshold: float):
        """Whether a candidate is a secret.

        The mean ratio must be above ``threshold``. A string below 20
        characters needs a letter and, with fewer transitions, as much evidence
        in total as one of 20. Separators inside a candidate are left out.
        """
        def secret(match: Column) -> Column:
            text = F.regexp_replace(match, "[.=~]", "")
            length = F.length(text)
            least = F.greatest(F.lit(1.0), (FULL_LENGTH - 1) / F.greatest(length - 1, F.lit(1)))
            wide = (length >= FULL_LENGTH) | ((length >= MIN_LENGTH) & text.rlike("[A-Za-z]"))
            return wide & (self.ratio(text) > threshold * least)

        return secret


def train(samples: DataFrame, smoothing: float = 0.5) -> Markov:
    """Both models from labelled samples (``text``, ``random`` boolean).

    NULL and empty texts count for nothing. With no sample of one label the
    model is empty and finds nothing. What comes to the driver is one row per
    label and pair of symbols, at most ``2 * SYMBOLS ** 2`` rows.
    """
    chars = samples.where("text <> '' and random is not null").select(
        "random", F.split("text", "").alias("c"))
    pairs = chars.select("random", F.explode(F.zip_with(
        F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))),
        F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))),
        lambda a, b: F.instr(F.lit(ALPHABET), a) * SYMBOLS
        + F.instr(F.lit(ALPHABET), b))).alias("pair"))
    counts = {True: {}, False: {}}
    for row in pairs.groupBy("random", "pair").count().collect():
        counts[row["random"]][row["pair"]] = row["count"]
    if not counts[True] or not counts[False]:
        return Markov(())

    def log_p(label: bool) -> list[float]:
        out = []
        for a in range(SYMBOLS):
            row = [counts[label].get(a * SYMBOLS + b, 0) for b in range(SYMBOLS)]
            total = math.log(sum(row) + smoothing * SYMBOLS)
            out += [math.log(n + smoothing) - total for n in row]
        return out

    return Markov(tuple(r - o for r, o in zip(log_p(True), log_p(False))))


def spans(text: Column, pattern: str, keep=None, kind: int = 0) -> Column:
    """Leftmost non-overlapping matches: array of (start, kind, stop), in code points.

    Positions are sums of the lengths of matches and of the texts between them.
    The sums run in blocks, so that n matches cost n times the block, not n squared.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    made = F.struct(
        hits.alias("h"),
        F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("g"))
    # A one-element array binds the struct once for all uses below.
    def place(x):
        h, g = x["h"], x["g"]
        step = F.transform(F.sequence(F.lit(0), F.size(h) - 1),
                           lambda i: F.get(g, i) + F.length(F.get(h, i)))
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(h) - 1) / _BLOCK).cast("int")),
            lambda j: F.aggregate(F.slice(step, j * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda a, b: a + b))
        return F.transform(F.array(F.struct(step.alias("s"), blocks.alias("b"))), lambda y: F.transform(
            F.sequence(F.lit(0), F.size(h) - 1), lambda i: _located(y, g, h, i, kind)))[0]

    found = F.transform(F.array(made), place)[0]
    if keep is not None:
        found = F.filter(found, lambda s: keep(s["text"]))
    bare = F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["stop"]))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    return F.when(text.rlike(pattern), bare.cast("array<struct<start:int,kind:int,stop:int>>")).otherwise(none)


def _located(sums, gaps, hits, i, kind):
    block = F.floor(i / _BLOCK).cast("int")
    start = (F.aggregate(F.slice(sums["b"], 1, block), F.lit(0), lambda a, b: a + b)
             + F.aggregate(F.slice(sums["s"], block * _BLOCK + 1, i - block * _BLOCK), F.lit(0),
                           lambda a, b: a + b) + F.get(gaps, i))
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"),
                    (start + F.length(F.get(hits, i))).alias("stop"), F.get(hits, i).alias("text"))


def base_spans(text: Column) -> list[Column]:
    """Spans of the three rules, one array each."""
    return [
        spans(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6, 0),
        spans(text, ACCESS, lambda m: F.length(m) >= 20, 1),
        spans(text, HEX, None, 2),
    ]


def scan(docs: DataFrame, model: Markov, threshold: float = 1.0) -> DataFrame:
    """Add ``base`` and ``spans``, arrays of (start, kind, stop), to the documents.

    ``kind`` is an index of ``KINDS``. A string of 16 or more letters, digits
    and ``+/_-`` that touches no base span is added if its mean log-likelihood
    ratio per transition is above ``threshold``, higher below 20 characters (see
    ``Markov.suspects``). So are runs of 6 or more such characters joined by
    ``.``, ``=`` or ``~``, judged as one string, where no part was found before.
    A NULL or empty text has no spans. Columns of these two names are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assign, access, hexes = base_spans(text)
    based = docs.withColumn("base", F.sort_array(F.concat(assign, access, hexes)))
    for pattern, so_far in ((CANDIDATE, "base"), (BROKEN, "spans")):
        free = spans(text, pattern, model.suspects(threshold), 3)
        based = based.withColumn("spans", _with_apart(so_far, free))
    return based


def _with_apart(found: str, more: Column) -> Column:
    """Spans so far and those of ``more`` that touch none of them, in order."""
    apart = F.filter(more, lambda s: ~F.exists(
        found, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return F.when(F.size(found) == 0, more).otherwise(F.sort_array(F.concat(F.col(found), apart)))


def as_text(column: str) -> Column:
    """kind:start:stop of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def labelled_samples(docs: DataFrame, sample_documents: int = 2000,
                     sample_spans: int = 20000) -> DataFrame:
    """Training samples labelled by the rules.

    Random strings: what the rules find, at most ``sample_spans`` of them over
    all documents. Ordinary identifiers: words of 6 or more ASCII letters,
    digits and ``_-`` that no rule touches, from at most ``sample_documents``
    documents. Both samples take the smallest hashes, so reruns agree.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    value = F.concat(
        F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6),
        F.filter(F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), lambda v: F.length(v) >= 20),
        F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))
    marked = docs.where(text.rlike(f"{ASSIGN}|{ACCESS}|{HEX}"))
    random = (marked.select(F.explode(value).alias("text")).distinct()
              .orderBy(F.xxhash64("text"), "text").limit(sample_spans))
    ids = (docs.select("doc_id").where("doc_id is not null")
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_documents).distinct())
    words = (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
             .select(F.explode(F.array_distinct(F.regexp_extract_all(
                 F.regexp_replace(text, f"{ASSIGN}|{ACCESS}|{HEX}", " "),
                 F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z0-9_-]{5,}(?![A-Za-z0-9+/_=-])"),
                 F.lit(0)))).alias("text")))
    return random.withColumn("random", F.lit(True)).unionByName(
        words.withColumn("random", F.lit(False)))


def redact(text: Column, model: Markov, threshold: float = 1.0, mark: str = "[secret]") -> Column:
    """The text with every secret replaced by the mark, in time linear in the text.

    The rules go first, in their order, then the model on what is left. A NULL
    text stays NULL.
    """
    ruled = _replaced(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6, mark)
    ruled = _replaced(ruled, ACCESS, lambda m: F.length(m) >= 20, mark)
    ruled = F.regexp_replace(ruled, HEX, mark)
    ruled = _replaced(ruled, CANDIDATE, model.suspects(threshold), mark)
    return _replaced(ruled, BROKEN, model.suspects(threshold), mark)


def _replaced(text: Column, pattern: str, secret, mark: str) -> Column:
    pieces = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.concat(gap, F.when(hit.isNull(), "").when(secret(hit), mark).otherwise(hit)))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)
