"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Both models are first-order chains over the characters of ALPHABET, estimated from labelled samples. A candidate is a
run of such characters outside the patterns' matches, which cut longer runs; it is a secret if its log-likelihood ratio,
random against ordinary, reaches ``min_ratio``, and its ratio for each character the limit that held-out ordinary samples
set. All steps are DataFrame functions, and texts are not shuffled. Positions are code points, ends are exclusive.

Lists of spans are folded in slices, and texts are cut into short blocks before pieces of them are taken, so that the
time a text takes grows with its length and hardly more than with the number of its spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.llm.tables import spare


@dataclass(frozen=True)
class Kind:
    """Matches of ``pattern`` whose group ``group`` has at least ``least`` characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # Runs are taken whole, so a shorter one has no part that would do.
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
)
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
MIN_LENGTH = 16  # characters of a candidate; shorter runs are not looked at
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
CUT = "array<struct<from:int,to:int,width:int,fresh:boolean>>"
MIN_RATIO = 12.0  # nats: a random string among some hundred thousand ordinary ones
BACKOFF = 0.1  # weight of the characters' own frequencies, so that pairs that training has not seen decide nothing alone
DEFAULT_LIMIT = 0.5  # nats a character, where no held-out sample sets it
# Words of ordinary identifiers, besides those of the documents (fixed values).
WORDS = (
    "abstract account adapter agent alpha always answer archive async author backup balance bean between block board bridge browser buffer "
    "button cache camera capital center change choice cipher class client cloud column command compact config connect content cookie country "
    "crypto cursor custom daily database debug decimal default depth device document domain download driver editor element email empty "
    "energy engine error every example export factory family field filter final first folder format forward frame friend function future "
    "garden global graph group growth handler header health height helper history house http icon image import index inner input item java "
    "journal kernel keyboard kitchen knowledge label layer level library light listen local logger lookup machine manager market maximum "
    "measure member merge message minute mobile model module monitor mouse native network never node normal notice number object office open "
    "option order output owner package page parent party patch path people phone place player plugin policy power present price print "
    "process profile project proxy public python quality query queue random reader region remote report request result return review river "
    "road route sample schema school screen search server service session shadow share simple socket source space spring state storage "
    "stream string style switch symbol system"
)
SLICE, BLOCK = 256, 64  # entries of an inner fold; code points of a block of text


def candidate(min_length: int = MIN_LENGTH) -> Kind:
    return Kind("markov", rf"[A-Za-z0-9+/_-]{{{min_length},}}")


def bound(value: Column, use) -> Column:
    """``use(v)`` with ``value`` evaluated once, whatever number of times ``v`` occurs."""
    return F.transform(F.array(value), use)[0]


def folded(items: Column, kind: str, step) -> Column:
    """A fold with a running position: ``step(at, item)`` gives (the next position, a list to append); returns (at, found)."""
    state = f"struct<at:int,found:{kind}>"
    none = F.array().cast(kind)

    def inner(now: Column, item: Column) -> Column:
        at, more = step(now["at"], item)
        return F.struct(at.alias("at"), F.concat(now["found"], more).alias("found")).cast(state)

    def outer(v: Column) -> Column:
        def add(all_: Column, k: Column) -> Column:
            part = F.aggregate(F.slice(v, k * SLICE + 1, F.lit(SLICE)), F.struct(all_["at"].alias("at"), none.alias("found")).cast(state), inner)
            return bound(part, lambda p: F.struct(p["at"].alias("at"), F.concat(all_["found"], p["found"]).alias("found")).cast(state))

        zero = F.struct(F.lit(0).alias("at"), none.alias("found")).cast(state)
        slices = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / SLICE).cast("int"))
        return F.when(F.size(v) > 0, F.aggregate(slices, zero, add)).otherwise(zero)

    return bound(items, outer)


def matches(text: Column, kind: Kind, rank: int, keep=None) -> Column:
    """Spans of the leftmost non-overlapping matches, in order, of those that ``keep`` keeps. The gaps that split()
    leaves give the positions."""
    pairs = F.zip_with(
        F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)),
        lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")),
    )

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        begin = at + pair["gap"]
        end = begin + F.length(pair["hit"])
        value = F.regexp_extract(pair["hit"], kind.pattern, kind.group) if kind.group else pair["hit"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"))
        good = F.length(value) >= kind.least if keep is None else keep(pair["hit"])
        return end, F.when(good, F.array(span)).otherwise(F.array()).cast(SPAN)

    # The last gap has no hit after it.
    hits = F.filter(pairs, lambda pair: pair["hit"].isNotNull())
    return F.when(text.rlike(kind.pattern), folded(hits, SPAN, step)["found"]).otherwise(F.array().cast(SPAN))


def replaced(text: Column, spans: Column, filler) -> Column:
    """``text`` with ``filler(cut)`` in place of each stretch that spans cover; they are sorted by start and may overlap.

    ``cut`` has the width of the stretch that a span adds, and whether it starts a stretch of its own (``fresh``).
    """

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        begin = F.greatest(at, s["start"])
        cut = F.struct(at.alias("from"), begin.alias("to"), F.greatest(s["end"] - begin, F.lit(0)).alias("width"), (s["start"] >= at).alias("fresh"))
        return F.greatest(at, s["end"]), F.array(cut).cast(CUT)

    def joined(v: Column) -> Column:
        def piece(begin: Column, end: Column) -> Column:
            first = F.floor(begin / BLOCK).cast("int")
            some = F.slice(v["blocks"], first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1)
            return F.when(end > begin, F.substring(F.array_join(some, ""), begin % BLOCK + 1, end - begin)).otherwise("")

        parts = F.transform(v["cuts"]["found"], lambda c: F.concat(piece(c["from"], c["to"]), filler(c)))
        return F.concat(F.array_join(parts, ""), piece(v["cuts"]["at"], v["length"]))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), 0)
    held = F.struct(blocks.alias("blocks"), folded(spans, CUT, step).alias("cuts"), F.length(text).alias("length"))
    return F.when(F.size(spans) > 0, bound(held, joined)).otherwise(text)


@dataclass(frozen=True)
class Markov:
    """Log-likelihood ratio of each pair of characters, in the order of ALPHABET, and of the first character."""

    pairs: list[float]
    first: list[float]
    limit: float = DEFAULT_LIMIT  # least ratio for each character of a secret

    def ratio(self, text: Column) -> Column:
        """Of a text of ALPHABET's characters."""
        pairs, first = (F.split(F.lit(",".join(f"{x:.6f}" for x in v)), ",").cast("array<double>") for v in (self.pairs, self.first))
        place = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        place = F.filter(place, lambda i: i >= 0)
        zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

        def step(state: Column, i: Column) -> Column:
            gain = F.when(state["last"] < 0, F.get(first, i)).otherwise(F.get(pairs, state["last"] * len(ALPHABET) + i))
            return F.struct(i.cast("int").alias("last"), (state["sum"] + gain).alias("sum"))

        return F.aggregate(place, zero, step)["sum"]


def train(samples: DataFrame) -> Markov:
    """From labelled samples (text, random boolean), with half a count added to every pair, mixed with the characters' own frequencies.

    Three quarters of the samples, by a hash of the text, are counted; of the others, the ordinary ones of at least
    MIN_LENGTH characters set the least ratio for a character, which all but one in 500 of them stay below. Pairs are
    counted by a grouped sum, so the driver gets two rows a pair of characters at most. Null texts or labels and characters
    outside ALPHABET are left out.
    """
    text = F.col("text")
    held_out = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    usable = samples.where("random is not null and length(text) > 0")
    padded = F.concat(F.lit(" "), text)
    pairs = usable.where(~held_out).select(
        "random", F.explode(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(padded, i, 2))).alias("pair")
    )
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}

    def chances(random: bool, before: str) -> list[float]:
        row = [counts.get((random, before + c), 0) + 0.5 for c in ALPHABET]
        return [math.log((1 - BACKOFF) * x / sum(row) + BACKOFF * alone[random][c]) for x, c in zip(row, ALPHABET)]

    alone = {}
    for kind in (False, True):
        single = {c: 0.5 + sum(n for (r, pair), n in counts.items() if r == kind and pair[1:] == c) for c in ALPHABET}
        alone[kind] = {c: n / sum(single.values()) for c, n in single.items()}

    def ratios(before: str) -> list[float]:
        return [a - b for a, b in zip(chances(True, before), chances(False, before))]

    model = Markov([x for c in ALPHABET for x in ratios(c)], ratios(" "))
    scored = usable.where(held_out & ~F.col("random") & text.rlike(candidate().pattern)).select((model.ratio(text) / F.length(text)).alias("rate"))
    limit = scored.agg(F.percentile_approx("rate", 0.998, 10_000)).first()[0]
    return replace(model, limit=max(0.0, limit) if limit is not None else DEFAULT_LIMIT)


def _forms(word: Column, other: Column, third: Column) -> Column:
    """Ordinary identifiers of three words: as they stand, in capitals, and joined in the usual ways."""
    low, lower_other, lower_third = F.lower(word), F.lower(other), F.lower(third)
    return F.array(
        word, F.upper(word), F.concat_ws("_", low, lower_other, lower_third), F.concat_ws("-", low, lower_other, lower_third),
        F.concat(F.initcap(low), F.initcap(lower_other), F.initcap(lower_third)), F.concat(low, F.initcap(lower_other), F.initcap(lower_third)),
        F.concat(F.upper(low), F.initcap(lower_other), F.initcap(lower_third)), F.concat_ws("_", F.upper(low), F.upper(other), F.upper(third)),
        F.concat(F.lit("/"), F.concat_ws("/", low, lower_other, lower_third)), F.concat_ws("/", low, F.concat(lower_other, F.lit("3")), lower_third),
        F.concat(low, lower_other, lower_third), F.concat(F.initcap(low), lower_other, lower_third),
    )


def labelled_samples(docs: DataFrame, id: str = "doc_id", text: str = "text", sample_rows: int = 2000, random_rows: int = 4000) -> DataFrame:
    """Labelled samples (text, random).

    Ordinary ones: words of about ``sample_rows`` documents and of WORDS, as they stand, in capitals and joined to
    identifiers and paths of three; dates, times, versions and plain numbers. Random ones: ``random_rows`` digests, written
    in hexadecimal, base 64 and capitals with digits. Both bounds are for training only; every document is scanned.
    """
    word = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\b[A-Za-z]{3,}\b"), F.lit(0)))
    share = min(1.0, sample_rows / max(1, docs.count()))
    chosen = F.pmod(F.xxhash64(id), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    common = F.split(F.lit(WORDS), " ")
    drawn = lambda of, salt: F.element_at(common, (F.pmod(F.xxhash64(of, F.lit(salt)), F.size(common)) + 1).cast("int"))
    words = docs.where(chosen & (F.length(text) > 0)).select(word.alias("w"))
    ids = docs.sparkSession.range(random_rows)
    ordinary = words.select(F.explode(_forms(F.col("w"), drawn(F.col("w"), 1), F.col("w"))).alias("text"))
    ordinary = ordinary.unionByName(
        docs.sparkSession.range(10 * random_rows).select(F.explode(_forms(drawn(F.col("id"), 1), drawn(F.col("id"), 2), drawn(F.col("id"), 3))).alias("text"))
    )
    moment = F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(2_000_000_000)))
    part = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("string")
    plain = F.array(
        F.lpad(F.col("id").cast("string"), 16, "0"), part(4, 10**16), F.date_format(moment, "yyyy-MM-dd'T'HH-mm-ss"), F.date_format(moment, "yyyyMMdd'T'HHmmss'Z'"),
        F.date_format(moment, "yyyy-MM-dd/HH-mm"), F.date_format(moment, "/yyyy/MM/dd/HH/mm/ss"), F.concat_ws("-", drawn(F.col("id"), 5), part(6, 30), part(7, 30), part(8, 99)),
        F.concat(drawn(F.col("id"), 9), F.lit("-v"), part(10, 9), F.lit("-"), F.date_format(moment, "yyyyMMdd")), F.concat(drawn(F.col("id"), 11), F.lit("_"), part(12, 10**6)),
    )
    ordinary = ordinary.unionByName(ids.select(F.explode(plain).alias("text"))).select("text", F.lit(False).alias("random"))
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    code = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    forms = F.array(digest, code, F.regexp_replace(F.upper(code), "[+/]", ""), F.translate(code, "+/", "-_"), F.regexp_replace(F.lower(code), "[+/]", ""))
    return ordinary.unionByName(ids.select(F.explode(forms).alias("text"), F.lit(True).alias("random")))


def base_spans(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """Spans of ``kinds``, sorted by start and then in the order of ``kinds``."""
    return F.array_sort(F.flatten(F.array(*(matches(text, kind, i) for i, kind in enumerate(kinds)))))


def added_spans(text: Column, model: Markov, rank: int = len(KINDS), min_ratio: float = MIN_RATIO, min_length: int = MIN_LENGTH) -> Column:
    """Spans the model adds in ``text``, whose pattern matches are blanked already."""

    def random(hit: Column) -> Column:
        return bound(model.ratio(hit), lambda r: (r >= min_ratio) & (r >= model.limit * F.length(hit)))

    return matches(text, candidate(min_length), rank, random)


def _with_spans(docs: DataFrame, model: Markov, text: str, min_ratio: float, min_length: int) -> tuple[DataFrame, str, str]:
    """``docs`` with the columns of base and added spans, whose names are returned."""
    base_name, added_name = spare(docs, "base_spans"), spare(docs, "added_spans")
    value = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn(base_name, base_spans(value))
    # The column of added spans holds the blanked text first.
    out = out.withColumn(added_name, replaced(value, F.col(base_name), lambda cut: F.repeat(F.lit(" "), cut["width"])))
    return out.withColumn(added_name, added_spans(F.col(added_name), model, min_ratio=min_ratio, min_length=min_length)), base_name, added_name


def _joined(found: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(found, one))


def _count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def scan(
    docs: DataFrame, model: Markov, id: str = "doc_id", text: str = "text", min_ratio: float = MIN_RATIO, min_length: int = MIN_LENGTH
) -> DataFrame:
    """One row for each row of ``docs``: id, n_<kind> of the fixed kinds, n_markov, base_sha256, spans. Null texts count
    as empty; a text without a span has the digest of the empty string."""
    out, base, added = _with_spans(docs.select(F.col(id).alias(id), F.col(text).alias(text)), model, text, min_ratio, min_length)
    counts = [_count(F.col(base), kind.name).alias(f"n_{kind.name}") for kind in KINDS]
    every = F.array_sort(F.concat(base, added))
    return out.select(
        id, *counts, F.size(added).cast("long").alias("n_markov"),
        F.sha2(_joined(F.col(base)).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"),
    )


def redact(
    docs: DataFrame, model: Markov, text: str = "text", mark: str = "[SECRET]", min_ratio: float = MIN_RATIO, min_length: int = MIN_LENGTH
) -> DataFrame:
    """``docs`` with every span replaced by ``mark``, overlapping ones by one mark. Rows, columns and texts without a
    secret stay as they are; null texts stay null."""
    out, base, added = _with_spans(docs, model, text, min_ratio, min_length)
    every = F.array_sort(F.concat(base, added))
    done = replaced(F.col(text), every, lambda cut: F.when(cut["fresh"], F.lit(mark)).otherwise(""))
    return out.withColumn(text, done).select(*docs.columns)
