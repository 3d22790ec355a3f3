"""J9 — the k best vacancies for every resume, exactly, without scoring all pairs.

The match score of a pair is (0.6 · skill share + 0.3 · same category + 0.1 ·
same level) · mean confidence. Vacancies are ranked by score, then confidence
(both descending), then id. Within one skill set, category and level this is the
order of confidence, whatever the resume. So only the k most confident
vacancies of a set can matter as far as category and level go (``shortlist``),
and of all vacancies that are better than their skills say, the k most
confident of a category and level can (``_by_label``).

1. Resumes with equal skills, category, level and confidence are one profile.
2. Each profile meets the short lists of its labels: k or more candidates, so
   the k-th score is a bound that any further vacancy has to reach.
3. Set join in rounds of falling skill share t. A vacancy set of n skills that
   shares t of them with a resume meets it in its n - ceil(t n) + 1 rarest
   skills, so the inverted index holds only these. A profile whose k-th score
   is above (0.6 t + 0.4) times the best mean confidence, t being the largest
   share that no round has taken yet, stops there.

Pairs are made of distinct skill sets, never of rows; a round keeps k rows for
each profile. Profiles that differ in confidence alone are a group: vacancies
that share as much with it and match its labels alike keep their order whatever
the resume's confidence, so only the k first of them meet its profiles.

These joins make many rows of few bytes, which AQE would put into one task.
Their rows are counted before, and the joins dealt to tasks of ROWS_A_TASK rows.
Only the short lists by label are always broadcast, whose size is checked.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtext.functions.match import DEC4, match_score, normalize_skills, skill_share
from jobtext.session import materialize

#: Skill shares of the rounds; the last one takes whatever shares a skill.
SHARES = (Fraction(1), Fraction(3, 4), Fraction(1, 2), Fraction(1, 4), Fraction(0))
#: Rows that a task of a join makes, about.
ROWS_A_TASK = 500_000
#: Most (category, level) combinations: labels of a classifier, whose lists are broadcast.
MOST_LABELS = 10_000

_VACANCY = ["vacancy_id", "vacancy_category", "vacancy_level", "vacancy_confidence"]
_KEPT = ["pid", "score", "skill_score", *_VACANCY]


def _sides(analysis: DataFrame, side: str) -> DataFrame:
    """Analysis rows (text_id, category, level, skills, confidence) with their skills as a sorted set."""
    names = {"text_id": f"{side}_id", "category": f"{side}_category", "level": f"{side}_level"}
    return analysis.select(*[F.col(a).alias(b) for a, b in names.items()], F.array_sort(normalize_skills("skills")).alias(f"{side}_set"),
                           F.coalesce(F.col("confidence"), F.lit(0)).cast(DEC4).alias(f"{side}_confidence"))


def shortlist(vacancies: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The vacancies that are among the ``k`` most confident of their ``keys``,
    category and level, with flags whether they are also among those of the
    category (in_c), the level (in_l) and all of ``keys`` (in_all). The k of a
    wider group are among the k of each part, so the first cut loses none."""
    best = [F.col("vacancy_confidence").desc(), F.col("vacancy_id")]
    place = lambda *more: F.row_number().over(Window.partitionBy(*keys, *more).orderBy(*best))
    rows = vacancies.withColumn("_p", place("vacancy_category", "vacancy_level")).where(F.col("_p") <= k).drop("_p")
    rows = rows.withColumn("in_c", place("vacancy_category") <= k).withColumn("in_l", place("vacancy_level") <= k)
    return rows.withColumn("in_all", place() <= k)


def _may_count(category: Column, level: Column) -> Column:
    """Whether a short-listed vacancy is one of the k for its relation to the labels."""
    same_c, same_l = category.eqNullSafe(F.col("vacancy_category")), level.eqNullSafe(F.col("vacancy_level"))
    return F.col("in_all") | (same_c & F.col("in_c")) | (same_l & F.col("in_l")) | (same_c & same_l)


def _scored(pairs: DataFrame, common: Column, size: Column, *more: str) -> DataFrame:
    share = skill_share(common, size)
    same = lambda x: F.coalesce(F.col(f"resume_{x}") == F.col(f"vacancy_{x}"), F.lit(False))
    score = match_score(F.col("skill_score"), same("category"), same("level"), F.col("resume_confidence"), F.col("vacancy_confidence"))
    return pairs.withColumn("skill_score", share).withColumn("score", score).select(*_KEPT, *more)


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k best distinct vacancies of each profile. Ranking by dense rank
    keeps repeats side by side and is cut to k before the shuffle."""
    order = [F.col("score").desc(), F.col("vacancy_confidence").desc(), F.col("vacancy_id")]
    ranked = rows.withColumn("rank", F.dense_rank().over(Window.partitionBy("pid").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).distinct()


def _by_label(profiles: DataFrame, vacancies: DataFrame, k: int) -> DataFrame:
    """Every profile with the vacancies that its labels alone let count. The
    lists have at most k rows for each category and level, each category, each
    level and all; they are broadcast one by one, the number of labels checked."""
    lists = materialize(shortlist(vacancies, [], k))
    labels = lists.select("vacancy_category", "vacancy_level").distinct().limit(MOST_LABELS + 1).count()
    if labels > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} combinations of category and level")
    item = F.struct(*_VACANCY, "vacancy_set")
    # up to 4 k rows for each profile
    profiles = profiles.repartition(1 + profiles.count() * 4 * k // ROWS_A_TASK, "pid")
    # without keys it is one row of the k best of all, a scalar
    out = profiles.withColumn("_a", lists.where("in_all").agg(F.collect_list(item)).scalar())
    for name, flag, keys in (("_cl", F.lit(True), ["category", "level"]), ("_c", F.col("in_c"), ["category"]), ("_l", F.col("in_l"), ["level"])):
        rows = lists.where(flag).groupBy(*[F.col(f"vacancy_{x}").alias(f"_{x}") for x in keys]).agg(F.collect_list(item).alias(name))
        on = [F.col(f"resume_{x}").eqNullSafe(F.col(f"_{x}")) for x in keys]
        out = out.join(F.broadcast(rows), on, "left").drop(*[f"_{x}" for x in keys])
    none = F.array().cast(out.schema["_a"].dataType)
    lists_of = F.array_distinct(F.concat(*[F.coalesce(x, none) for x in ("_cl", "_c", "_l", "_a")]))
    rows = out.select(*profiles.columns, F.explode(lists_of).alias("v")).select(*profiles.columns, "v.*")
    return _scored(rows, F.size(F.array_intersect("resume_set", "vacancy_set")), F.size("vacancy_set"))


def _by_rarity(sets: DataFrame) -> DataFrame:
    """(vacancy_set) with its skills, rarest first."""
    skills = sets.select("vacancy_set", F.explode("vacancy_set").alias("skill"))
    counts = skills.groupBy("skill").agg(F.count(F.lit(1)).alias("n"))
    lists = skills.join(counts, "skill").groupBy("vacancy_set").agg(F.sort_array(F.collect_list(F.struct("n", "skill"))).alias("s"))
    return lists.select("vacancy_set", F.col("s.skill").alias("rare"))


def _tasks(counts: DataFrame, rows: Column) -> int:
    """Tasks for a join that makes ``rows`` rows for each of ``counts``."""
    return 1 + (counts.agg(F.sum(rows)).first()[0] or 0) // ROWS_A_TASK


def _first_of_group(groups: DataFrame, pairs: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """(gid, common, vacancy columns): of the short-listed vacancies that meet a
    group those that are among the ``k`` first, by confidence and id, of their
    skill share and relation to its labels."""
    size = lambda df, name: df.groupBy(name).agg(F.count(F.lit(1)).alias(f"_{name}"))
    made = pairs.join(size(groups, "resume_set"), "resume_set").join(size(lists, "vacancy_set"), "vacancy_set")
    n = _tasks(made, F.col("_resume_set") * F.col("_vacancy_set"))
    rows = pairs.repartition(n, "resume_set", "vacancy_set").join(groups, "resume_set").join(lists, "vacancy_set")
    rows = rows.where(_may_count(F.col("resume_category"), F.col("resume_level")))
    same = [F.coalesce(F.col(f"resume_{x}") == F.col(f"vacancy_{x}"), F.lit(False)) for x in ("category", "level")]
    alike = Window.partitionBy("gid", skill_share(F.col("common"), F.size("vacancy_set")), *same)
    # dense: an id with two analyses keeps its place
    rows = rows.withColumn("_p", F.dense_rank().over(alike.orderBy(F.col("vacancy_confidence").desc(), "vacancy_id"))).where(F.col("_p") <= k)
    return rows.select("gid", "common", *_VACANCY, "vacancy_set")


def _meeting(resume_sets: DataFrame, rare: DataFrame, share: Fraction, above: Fraction | None) -> DataFrame:
    """(resume_set, vacancy_set, common) of the sets whose share of the
    vacancy's skills is ``share`` or more (more than none for 0) and below ``above``."""
    size = F.size("rare")
    need = F.greatest(F.lit(1), F.ceil(size * share.numerator / share.denominator).cast("int"))
    index = rare.select("vacancy_set", "rare", F.posexplode(F.slice("rare", F.lit(1), size - need + 1)).alias("i", "skill"))
    seen = resume_sets.select("resume_set", F.explode("resume_set").alias("skill"))
    made = index.groupBy("skill").agg(F.count(F.lit(1)).alias("a")).join(seen.groupBy("skill").agg(F.count(F.lit(1)).alias("b")), "skill")
    n = _tasks(made, F.col("a") * F.col("b"))
    # a frequent skill is met in parts, too
    seen = seen.withColumn("part", F.pmod(F.xxhash64("resume_set"), F.lit(n)).cast("int"))
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = index.repartition(n, "part").join(seen.repartition(n, "part"), ["part", "skill"])
    # the pair is made at the rarest skill that both have, nowhere else
    pairs = pairs.where(~F.arrays_overlap(F.slice("rare", F.lit(1), F.col("i")), F.col("resume_set")))
    pairs = pairs.withColumn("common", F.size(F.array_intersect("vacancy_set", "resume_set")))
    pairs = pairs.where(F.col("common") * share.denominator >= size * share.numerator)
    if above is not None:
        pairs = pairs.where(F.col("common") * above.denominator < size * above.numerator)
    return pairs.select("resume_set", "vacancy_set", "common")


def rank_vacancies(resumes: DataFrame, vacancies: DataFrame, k: int) -> DataFrame:
    """Two analysis tables (text_id, category, level, skills, confidence) to
    (resume_id, rank, vacancy_id, skill_score, match_score): each resume's k
    best vacancies (all, if there are fewer), ranked from 1.

    A null label equals none; a null confidence is zero; null and empty skill
    lists share nothing. A resume id that occurs twice is ranked for each of
    its analyses; a vacancy id that repeats with equal analysis is one."""
    found = _sides(resumes, "resume")
    offers = materialize(_sides(vacancies, "vacancy").distinct())
    names = ["resume_set", "resume_category", "resume_level", "resume_confidence"]
    groups = materialize(found.select(*names[:3]).distinct().withColumn("gid", F.monotonically_increasing_id()))
    told = groups.select("gid", *[F.col(x).alias(f"_{x}") for x in names[:3]])
    profiles = found.select(*names).distinct().join(told, [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in names[:3]]).select(*names, "gid")
    profiles = materialize(profiles.withColumn("pid", F.monotonically_increasing_id()))
    top = materialize(_best(_by_label(profiles, offers, k), k))

    lists = materialize(shortlist(offers.where(F.size("vacancy_set") > 0), ["vacancy_set"], k))
    rare = materialize(_by_rarity(lists.select("vacancy_set").distinct()))
    most, widest = lists.agg(F.max("vacancy_confidence"), F.max(F.size("vacancy_set"))).first()
    above = None
    for share in SHARES if most is not None else ():
        # what is not yet met: any share, or one below the last round's a/b, so at least 1/(b n) below it
        left = Fraction(1) if above is None else above - Fraction(1, above.denominator * widest)
        left = (Decimal(left.numerator) / left.denominator).quantize(Decimal("0.0001"), ROUND_HALF_UP)
        # a score equal to the bound may still win by confidence or id
        bound = match_score(F.lit(left), F.lit(True), F.lit(True), F.col("resume_confidence"), F.lit(most))
        least = top.groupBy("pid").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        open_ = profiles.join(least, "pid", "left").where((F.coalesce("n", F.lit(0)) < k) | (F.col("least") <= bound))
        open_ = materialize(open_.select(*profiles.columns, F.when(F.col("n") >= k, F.col("least")).alias("least")))
        if open_.isEmpty():
            break
        pairs = materialize(_meeting(open_.select("resume_set").distinct(), rare, share, above))
        first = materialize(_first_of_group(groups.join(open_.select("gid").distinct(), "gid", "left_semi"), pairs, lists, k))
        made = open_.groupBy("gid").agg(F.count(F.lit(1)).alias("a")).join(first.groupBy("gid").agg(F.count(F.lit(1)).alias("b")), "gid")
        n = _tasks(made, F.col("a") * F.col("b"))
        rows = open_.repartition(n, "gid").join(first.repartition(n, "gid"), "gid")
        new = _scored(rows, F.col("common"), F.size("vacancy_set"), "least").where(F.col("least").isNull() | (F.col("score") >= F.col("least"))).drop("least")
        top = materialize(_best(top.drop("rank").unionByName(new), k))
        above = share
    named = profiles.select("pid", *[F.col(x).alias(f"_{x}") for x in names])
    named = found.join(named, [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in names])
    return named.join(top, "pid").select("resume_id", "rank", "vacancy_id", "skill_score", F.col("score").alias("match_score"))
