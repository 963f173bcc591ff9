"""Population search over edited strings, for all targets at once.

A generation is one plan keyed by target: rank, keep the elite, breed, score.
Random choices are hashes of (target, generation, member, position, seed), so a task that
runs again makes the same choices.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from seqloom.functions import digests, flat
from seqloom.functions import lookups as L
from seqloom.functions import sequences as S
from seqloom.session import checkpoint_folder, cut, discard, spread_keys


@dataclass(frozen=True)
class SearchSettings:
    # The search's default sizes and stopping thresholds.
    population: int = 500
    generations: int = 50
    change_percent: int = 50
    elite_percent: int = 10
    parents: int = 50
    stop_score: float = 0.95
    stop_outlier: float = 1.3
    stop_diff: int = 1
    w1: float = 1.0
    w2: float = 1.0
    w3: float = 1.0
    seed: int = 42


def _digest(*parts: Column | int) -> Column:
    """32 hex digits that depend on the parts alone, so that any engine throws the same dice: of the parts that are not
    null, joined by colons.  The last part is never null."""
    text, fixed = [], ""
    for i, part in enumerate(parts):
        colon = ":" if i < len(parts) - 1 else ""
        if isinstance(part, int):
            fixed += f"{part}{colon}"
            continue
        text += [F.lit(fixed)] if fixed else []
        text.append(F.coalesce(F.concat(part.cast("string"), F.lit(colon)), F.lit("")) if colon else part.cast("string"))
        fixed = ""
    return F.md5(F.concat(*text, *([F.lit(fixed)] if fixed else [])))


def _dice(digest: Column, first: int, sides: int | Column) -> Column:
    """A number 0..sides-1 from the eight digits at place ``first``."""
    number = F.conv(F.substring(digest, first, 8), 16, 10).cast("long")
    return F.pmod(number, F.lit(sides) if isinstance(sides, int) else sides).cast("int")


def _salt(*parts: Column) -> Column:
    """The beginning of the text that `_digest` takes: of the parts that are not null, each with a colon."""
    return F.concat(*[F.coalesce(F.concat(part.cast("string"), F.lit(":")), F.lit("")) for part in parts])


def with_each(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows joined with their ``columns`` by target_id, where rows of a target lie: a target that comes twice meets both."""
    each = F.collect_list(F.struct(*columns)).over(W.partitionBy("target_id"))
    own = [c for c in rows.columns if c not in columns]
    return rows.filter("target_id is not null").select(*own, each.alias("_each")).select(*own, F.inline("_each"))


#: Dice that are thrown together.
THROWN = 1 << 16


def variants_random(targets: DataFrame, size: int, change_percent: int = 50, seed: int = 42) -> DataFrame:
    """The targets' columns and member, seq: ``size`` strings per target, each with length * percent / 100
    replacements; a position may be drawn again, and the new letter always differs from the one it replaces.

    Replacement j of a member throws the digest of (target_id, member, j, seed), as `_digest` and `_dice` give it.  A target's
    strings are made as one array, so they stay with their target.
    """
    places = {a: i for i, a in enumerate(L.LETTERS)}
    code = flat.table_of([places.get(chr(64 + i), 0) for i in range(1, 27)])
    new = np.frombuffer(L.LETTERS.encode("ascii"), "uint8")

    def edited(letters: np.ndarray, n: np.ndarray, salts: list[bytes], draws: int) -> np.ndarray:
        """Members of targets with as many replacements: targets by members by places."""
        out = np.repeat(letters[:, None], size, axis=1)
        suffixes = [f"{m}:{j}:{seed}".encode() for j in range(1, draws + 1) for m in range(1, size + 1)]
        place, step = digests.digits(salts, suffixes, 2).reshape(2, len(n), draws, size).astype("int64")
        for j in range(draws):
            at = (place[:, j] % n[:, None])[:, :, None]
            old = code[np.take_along_axis(out, at, 2)]
            if (old < 0).any():
                raise ValueError("a string has a character that is no letter A to Z")
            np.put_along_axis(out, at, new[(old + (step[:, j] % 19)[:, :, None] + 1) % 20], 2)
        return out

    @F.arrow_udf("array<string>")
    def members(texts: pa.Array, salts: pa.Array) -> pa.Array:
        if not pc.all(pc.string_is_ascii(pc.fill_null(texts, ""))).as_py():
            raise ValueError("a string has a character that is no letter A to Z")
        letters, at = flat.flat(texts)
        salts, lengths = [x.encode() for x in salts.to_pylist()], np.diff(at)
        draws = np.floor(lengths * change_percent / 100).astype("int64")
        strings, order = [pa.array([], pa.string())], [np.empty(0, "int64")]
        for d in np.unique(draws).tolist():
            rows = np.flatnonzero(draws == d)
            together = max(1, THROWN // max(1, size * max(d, int(lengths[rows].max()))))
            for own in (rows[s : s + together] for s in range(0, len(rows), together)):
                n = lengths[own]
                there = np.arange(n.max()) < n[:, None]
                laid = np.zeros(there.shape, "uint8")
                laid[there] = letters[np.repeat(at[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                made = edited(laid, n, [salts[i] for i in own], d)[np.repeat(there[:, None], size, axis=1)]
                bounds = np.append(0, np.cumsum(np.repeat(n, size))).astype("int32")
                strings.append(pa.StringArray.from_buffers(len(own) * size, pa.py_buffer(bounds), pa.py_buffer(made)))
                order.append(own)
        back = np.argsort(np.concatenate(order), kind="stable")
        seq = pa.concat_arrays(strings).take(pa.array((back[:, None] * size + np.arange(size)).ravel()))
        if texts.null_count:
            seq = pc.if_else(pa.array(np.repeat(np.asarray(pc.is_null(texts)), size)), pa.scalar(None, pa.string()), seq)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(back) + 1, dtype="int32") * size), seq)

    made = targets.withColumn("_seqs", members("target", _salt(F.col("target_id"))))
    # an outer one: the plan would filter by the size of the arrays, and make them twice
    rows = made.select(*targets.columns, F.posexplode_outer("_seqs").alias("member", "seq"))
    return rows.withColumn("member", F.col("member") + 1)


@dataclass(frozen=True)
class BatchScores:
    """Columns that are made of new strings where these are made: of a batch that has their targets' columns and ``seq``."""

    fields: Sequence[StructField]
    of: Callable[[pa.RecordBatch], list[pa.Array]]


def variants_single(targets: DataFrame, scores: BatchScores | None = None) -> DataFrame:
    """The targets' columns and pos, letter, seq: every string one replacement away; and the columns of ``scores``."""
    fields = [*targets.schema.fields, StructField("pos", IntegerType()), StructField("letter", StringType()), StructField("seq", StringType())]
    names = [f.name for f in fields]
    schema = StructType([*fields, *(scores.fields if scores else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = pa.array(list(L.LETTERS))
        for batch in batches:
            for row, place, letter, seq in flat.single_variants(batch.column("target"), L.LETTERS):
                which = pa.array(row)
                made = [pa.array((place + 1).astype("int32")), alphabet.take(pa.array(letter)), seq]
                rows = pa.RecordBatch.from_arrays([*(c.take(which) for c in batch.columns), *made], names)
                yield pa.RecordBatch.from_arrays([*rows.columns, *scores.of(rows)], schema.names) if scores else rows

    return targets.mapInArrow(run, schema)


def _child(first: str | None, second: str | None, salt: str) -> str:
    out = []
    for i, (a, b) in enumerate(zip_longest(first, second, fillvalue="") if first is not None and second is not None else []):
        digest = hashlib.md5(f"{salt}{i}".encode()).hexdigest()
        luck = int(digest[:8], 16) % 100
        out.append(a if luck < 45 else b if luck < 90 else L.LETTERS[int(digest[8:16], 16) % 20])
    return "".join(out)


def crossover(first: Column, second: Column, *salt) -> Column:
    """Per position: 45 in 100 the first parent's letter, 45 the second's, 10 any letter.

    A place throws the digest of (salt, place from 0), as `_digest` and `_dice` give it.
    """
    letters = np.frombuffer(L.LETTERS.encode("ascii"), "uint8")

    def of_letters(first: pa.Array, second: pa.Array, salts: pa.Array) -> pa.Array:
        (a, at), (b, _) = flat.flat(first), flat.flat(second)
        n = np.diff(at)
        there = np.arange(n.max(initial=0)) < n[:, None]
        thrown = digests.digits([x.encode() for x in salts.to_pylist()], [str(i).encode() for i in range(there.shape[1])], 2)
        luck, other = (x[there] for x in thrown)
        luck %= 100
        out = np.where(luck < 45, a, np.where(luck < 90, b, letters[other % 20]))
        return pa.StringArray.from_buffers(len(n), pa.py_buffer(at.astype("int32")), pa.py_buffer(out))

    def bred(first: pa.Array, second: pa.Array, salts: pa.Array) -> pa.Array:
        alike = pc.equal(pc.binary_length(first), pc.binary_length(second))
        ascii_ = pc.and_(pc.string_is_ascii(first), pc.string_is_ascii(second))
        if first.null_count or second.null_count or not pc.all(pc.and_(alike, ascii_)).as_py():
            return pa.array([_child(*x) for x in zip(first.to_pylist(), second.to_pylist(), salts.to_pylist())], pa.string())
        longest = max(1, pc.max(pc.binary_length(first)).as_py() or 0)
        step = max(1, THROWN // longest)
        parts = [of_letters(*(c.slice(s, step) for c in (first, second, salts))) for s in range(0, len(first), step)]
        return flat.joined(parts, pa.string())

    @F.arrow_udf("string")
    def child(first: pa.Array, second: pa.Array, salts: pa.Array) -> pa.Array:
        return bred(first, second, salts)

    return child(first, second, _salt(*salt))


def alignment(scores: dict[tuple[str, str], float] | None = None) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """`alignment_score` for the strings of a batch."""
    table = scores or L.similarity_scores()
    cells = np.array([float(table[x, y]) for x in L.LETTERS for y in L.LETTERS])
    places = {x: i for i, x in enumerate(L.LETTERS)}
    codes = flat.table_of([places.get(chr(64 + i), 0) for i in range(1, 27)])
    return lambda first, second: flat.by_pieces(lambda x, y: flat.pair_sum(x, y, codes, cells), pa.float64(), first, second)


def alignment_score(a: Column | str, b: Column | str, scores: dict[tuple[str, str], float] | None = None) -> Column:
    """Sum of the substitution scores of letters at the same place."""
    score = alignment(scores)

    @F.arrow_udf("double")
    def total(first: pa.Array, second: pa.Array) -> pa.Array:
        return score(first, second)

    return total(S.col(a), S.col(b))


def similarity_distance(target: Column | str, query: Column | str, self_score: Column | str, scores=None) -> Column:
    """1 - score(target, query) / score(target, target); the self score is computed once per target."""
    return 1 - F.try_divide(alignment_score(target, query, scores), S.col(self_score))


def similarity_distances(scores=None) -> Callable[[pa.Array, pa.Array, pa.Array], pa.Array]:
    """`similarity_distance` for the strings of a batch."""
    score = alignment(scores)

    def distances(target: pa.Array, query: pa.Array, self_score: pa.Array) -> pa.Array:
        own = pc.if_else(pc.equal(self_score, 0.0), pa.scalar(None, pa.float64()), self_score)
        return pc.subtract(1.0, pc.divide(score(target, query), own))

    return distances


def fitness(
    distance: Column | str | np.ndarray, p: Column | str | np.ndarray, outlier: Column | str | np.ndarray,
    w1: float = 1.0, w2: float = 1.0, w3: float = 1.0,
) -> Column | np.ndarray:
    """Weighted distance, shortfall of the score below 0.8 and outlier score above 1.5; low is good.

    Of columns, or of the numbers of a batch.
    """
    batch = isinstance(distance, np.ndarray)
    d, p, o = (distance, p, outlier) if batch else (S.col(distance), S.col(p), S.col(outlier))
    above_zero = (lambda x: np.maximum(x, 0.0)) if batch else (lambda x: F.greatest(x, F.lit(0.0)))
    short = above_zero((1 - p) * (1 - p) - 0.2 * 0.2)
    odd = above_zero(o * o - 1.5 * 1.5)
    return w1 * d + w2 * short + w3 * odd


Objective = Callable[[SearchSettings], Column]


def weighted_objective(settings: SearchSettings) -> Column:
    return fitness("distance", "p", "outlier", settings.w1, settings.w2, settings.w3)


def score_candidates(
    candidates: DataFrame,
    featurize: Callable[[DataFrame], DataFrame],
    predict: Callable[[DataFrame], DataFrame],
    outlier: Callable[[DataFrame], DataFrame],
    settings: SearchSettings = SearchSettings(),
    objective: Objective = weighted_objective,
    scores: dict[tuple[str, str], float] | None = None,
) -> DataFrame:
    """Add p, outlier, distance, n_diff and fitness to (target_id, target, self_score, member, seq).

    ``featurize`` adds ``features`` to rows that have ``seq``; ``predict`` and ``outlier`` each add
    their column to rows that have ``features``.
    """
    rows = outlier(predict(featurize(candidates))).drop("features")
    rows = rows.withColumn("distance", similarity_distance("target", "seq", "self_score", scores))
    rows = rows.withColumn("n_diff", S.hamming("target", "seq", batched=True))
    return rows.withColumn("fitness", objective(settings))


def average_of(predictors: Sequence[Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame], DataFrame]:
    """Several models as one: a function that adds ``p``, the mean of theirs."""

    def predict(df: DataFrame) -> DataFrame:
        rows = df
        for i, one in enumerate(predictors):
            rows = one(rows).withColumnRenamed("p", f"_p{i}")
        each = [F.col(f"_p{i}") for i in range(len(predictors))]
        return rows.withColumn("p", sum(each[1:], each[0]) / len(each)).drop(*[f"_p{i}" for i in range(len(each))])

    return predict


def ranked(population: DataFrame) -> DataFrame:
    """Rank within each target by fitness; a target has as many rows as the population's set size."""
    order = W.partitionBy("target_id").orderBy("fitness", "seq", "member")
    return population.withColumn("place", F.row_number().over(order))


def elite(population: DataFrame, percent: int = 10) -> DataFrame:
    """The best ``percent`` of each target's members, rounded down."""
    order = W.partitionBy("target_id").orderBy("fitness", "seq", "member")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # in the same order, so one sort does
    best = population.select("*", F.row_number().over(order).alias("place"), F.count("*").over(whole).alias("_size"))
    return best.filter(F.col("place") * 100 <= F.col("_size") * percent).drop("_size")


#: Couples that are drawn together.
COUPLES = 1 << 14


def parents(population: DataFrame, children: int, pool: int, generation: int, seed: int) -> DataFrame:
    """(target_id, target, self_score, initial_p, member, first, second): two draws from each target's best ``pool``.

    A draw is the number in the digest of (target_id, member, generation, seed, side), as `_digest` and `_dice` give it.
    """
    keys = ["target_id", "target", "self_score", "initial_p"]
    best = ranked(population).filter(F.col("place") <= pool)
    listed = best.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "seq"))), lambda c: c["seq"]).alias("_pool")
    )
    listed = listed.withColumn("_salt", F.coalesce(F.concat(F.col("target_id").cast("string"), F.lit(":")), F.lit("")))
    sides = [[f"{m}:{generation}:{seed}:{side}".encode() for m in range(1, children + 1)] for side in (1, 2)]
    at_once = max(1, COUPLES // max(1, children))
    seq = population.schema["seq"].dataType
    drawn = [StructField("member", IntegerType()), StructField("first", seq), StructField("second", seq)]
    schema = StructType([*(listed.schema[k] for k in keys), *drawn])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = np.arange(1, children + 1, dtype="int32")
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                rows = batch.slice(start, at_once)
                pools, salts = rows.column("_pool"), [x.encode() for x in rows.column("_salt").to_pylist()]
                sizes = pools.value_lengths().to_numpy()[:, None]
                begins = (np.cumsum(sizes) - sizes.ravel())[:, None]
                members_of = pools.flatten()
                which = pa.array(np.repeat(np.arange(rows.num_rows), children))
                couples = [
                    members_of.take(pa.array((begins + digests.first_digits(salts, side) % sizes).ravel())) for side in sides
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(k).take(which) for k in keys), pa.array(np.tile(members, rows.num_rows)), *couples], schema.names
                )

    return listed.mapInArrow(run, schema)


def best_per_distance(population: DataFrame) -> DataFrame:
    """The lowest fitness per target and number of changed letters."""
    best = F.min(F.struct("fitness", "seq", "p", "outlier")).alias("_b")
    return population.groupBy("target_id", "n_diff").agg(best).select("target_id", "n_diff", "_b.*")


def generation_log(population: DataFrame) -> DataFrame:
    """The best member per target and generation with its scores."""
    best = F.min(F.struct("fitness", "seq", "p", "outlier", "n_diff")).alias("_b")
    return population.groupBy("target_id", "generation").agg(best).select("target_id", "generation", "_b.*")


def has_stopped(settings: SearchSettings = SearchSettings()) -> Column:
    """A best member that scores high, is not odd and changed at most one letter, or changed none."""
    good = (F.col("p") > settings.stop_score) & (F.col("outlier") < settings.stop_outlier)
    return (good & (F.col("n_diff") <= settings.stop_diff)) | (F.col("n_diff") == 0)


def unfinished(population: DataFrame, log: DataFrame, settings: SearchSettings = SearchSettings()) -> DataFrame:
    """Members of the targets whose best member does not meet the stopping rule."""
    stopped = log.filter(has_stopped(settings)).select("target_id")
    # the plan takes exploded rows for as few as their table has, and would send them to the driver
    return population.join(stopped.hint("shuffle_hash"), "target_id", "left_anti")


#: Members of the populations that are on disk together, about, and targets that one task searches.
HELD, TARGETS_AT_ONCE = 1 << 23, 4000


@dataclass
class SearchResult:
    log: DataFrame
    best: DataFrame


def evolve(
    targets: DataFrame,
    featurize: Callable[[DataFrame], DataFrame],
    predict: Callable[[DataFrame], DataFrame],
    outlier: Callable[[DataFrame], DataFrame],
    settings: SearchSettings = SearchSettings(),
    objective: Objective = weighted_objective,
    scores: dict[tuple[str, str], float] | None = None,
) -> SearchResult:
    """Run the generations for every (target_id, target).

    Targets are searched in rounds, so that the populations on disk have about ``HELD`` members whatever the number of
    targets.  Within a round each generation is cut to the checkpoint folder, dealt by target, which keeps the plan short and the
    population safe when executors are lost, and deleted when the next one is there.  Scores travel with the elite; only
    children are scored again.
    """
    spark = targets.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/search-{uuid.uuid4().hex}"

    def scored(rows: DataFrame) -> DataFrame:
        return score_candidates(rows, featurize, predict, outlier, settings, objective, scores)

    def kept_as(rows: DataFrame, name: str) -> None:
        rows.write.mode("append").parquet(f"{folder}/{name}")

    prepared = targets.select("target_id", F.trim("target").alias("target"))
    start = predict(featurize(prepared.withColumn("seq", F.col("target")))).select(
        "target_id", "target", alignment_score("target", "target", scores).alias("self_score"), F.col("p").alias("initial_p")
    )
    start = cut(start)
    rounds = max(1, -(-start.count() * settings.population // HELD))
    children = settings.population * (100 - settings.elite_percent) // 100
    for turn in range(rounds):
        # not the hash that rows are dealt by
        own = start.filter(F.pmod(F.xxhash64("target_id"), F.lit(rounds)) == turn)
        own = cut(spread_keys(own, "target_id", TARGETS_AT_ONCE))
        tasks = own.rdd.getNumPartitions()

        def dealt(rows: DataFrame) -> DataFrame:
            return cut(rows.repartition(tasks, "target_id").sortWithinPartitions("target_id", "fitness", "seq", "member"))

        first = variants_random(with_each(own, "self_score", "initial_p"), settings.population, settings.change_percent, settings.seed)
        population, best = dealt(scored(first)), None
        for generation in range(1, settings.generations + 1):
            so_far, best = best, best_per_distance(population)
            best = cut(best if so_far is None else best_per_distance(so_far.unionByName(best)))
            leaders = cut(generation_log(population.withColumn("generation", F.lit(generation))))
            going = unfinished(population, leaders, settings)
            # the leaders of those that go on
            log = leaders.join(leaders.filter(has_stopped(settings)).select("target_id").hint("shuffle_hash"), "target_id", "left_anti")
            kept_as(log.join(own.select("target_id", "target", "initial_p").hint("shuffle_hash"), "target_id"), "log")
            made = [leaders, population, *([] if so_far is None else [so_far])]
            if generation == settings.generations or log.isEmpty():
                discard(*made)
                break
            kept = elite(going, settings.elite_percent).drop("place")
            couples = parents(going, children, settings.parents, generation, settings.seed)
            salt = (F.col("target_id"), F.col("member"), F.lit(generation), F.lit(settings.seed))
            born = couples.select(
                "target_id", "target", "self_score", "initial_p", "member",
                crossover(F.col("first"), F.col("second"), *salt).alias("seq"),
            )
            population = dealt(kept.unionByName(scored(born).select(*kept.columns)))
            discard(*made)
        kept_as(best, "best")
        kinds = {"log": log.join(own.select("target_id", "target", "initial_p"), "target_id").schema, "best": best.schema}
        discard(own, best)
        # the cleaner deletes the shuffles of plans that are gone
        del own, population, best, so_far, leaders, going, log, made
        spark._jvm.System.gc()
    discard(start)
    return SearchResult(*(spark.read.schema(kinds[name]).parquet(f"{folder}/{name}") for name in ("log", "best")))


#: Rows whose nearest training rows are looked up together.
ASKED = 1 << 14


def outlier_column(train: DataFrame, key: str, vector: str, k: int = 20, limit: int = 64 << 20) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``outlier`` to rows with ``features``, from training rows fitted once.

    Small fitted tables (size checked) travel to the tasks; larger ones are joined.
    """
    from seqloom.operators import neighbours as N
    from seqloom.operators.dependence import matrix
    from seqloom.operators.ordinal import row_ordinals

    fitted = cut(N.lof_fit(train, key, vector, k))
    size = train.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    if size["n"] * (size["d"] + 3) * 8 <= limit:
        rows = train.select(F.col(key).alias("train_id"), F.col(vector).cast("array<double>").alias("_x")).join(fitted, "train_id")
        table = rows.orderBy("train_id").toArrow()
        held = train.sparkSession.sparkContext.broadcast(
            (matrix(table.column("_x")), table.column("k_distance").to_numpy(), table.column("density").to_numpy())
        )

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            x, far, dense = held.value
            rows = N.Boxed(x)
            for v in batches:
                if v.null_count:
                    raise ValueError("a row without features")
                q = matrix(v)
                out = np.empty(len(q))
                for s in range(0, len(q), ASKED):  # so many queries that those of a block are near each other
                    near, d = rows.top_k(q[s : s + ASKED], k)
                    out[s : s + ASKED] = dense[near].mean(axis=1) * (np.maximum(d, far[near]).mean(axis=1) + 1e-10)
                yield pa.array(out)

        return lambda df: df.withColumn("outlier", score("features"))

    def joined(df: DataFrame) -> DataFrame:
        numbered = cut(row_ordinals(df, [], ["target_id", "member", "seq"], "_id"))
        queries = numbered.select(F.col("_id").alias("id"), F.col("features").alias("x"))
        base = train.select(F.col(key).alias("id"), F.col(vector).alias("x"))
        found = N.lof_score(queries, base, fitted, "id", "x", k)
        return numbered.join(found.select(F.col("query_id").alias("_id"), "outlier"), "_id").drop("_id")

    return joined
