"""Queries of fuzzy relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import fuzzy as fz
from quillon.plans.register import query, table

#: Scores for every part: its size and price stand for the two legs and the fit.
INPUT_SQL = """i AS (SELECT p_partkey AS id, (p_partkey * 37 % 101) / 100::DOUBLE AS s, (p_size * 53 % 101) / 100::DOUBLE AS k, (p_partkey * 11 % 101) / 100::DOUBLE AS f,
  ['Low', 'Medium', 'High', 'Very High'][(p_size % 4 + 1)::INTEGER] AS c FROM part)"""
MEMBER_SQL = f"""{INPUT_SQL},
m AS (SELECT *,
  CASE WHEN s <= 0.25 THEN 1 WHEN s <= 0.45 THEN (0.45::DOUBLE - s) / 0.2::DOUBLE ELSE 0 END::DOUBLE AS sem_low,
  CASE WHEN s <= 0.25 THEN 0 WHEN s <= 0.45 THEN (s - 0.25::DOUBLE) / 0.2::DOUBLE WHEN s <= 0.65 THEN (0.65::DOUBLE - s) / 0.2::DOUBLE ELSE 0 END::DOUBLE AS sem_medium,
  CASE WHEN s <= 0.45 THEN 0 WHEN s <= 0.65 THEN (s - 0.45::DOUBLE) / 0.2::DOUBLE ELSE 1 END::DOUBLE AS sem_high,
  CASE WHEN k <= 0.1 THEN 1 WHEN k <= 0.25 THEN (0.25::DOUBLE - k) / 0.15::DOUBLE ELSE 0 END::DOUBLE AS key_weak,
  CASE WHEN k <= 0.1 THEN 0 WHEN k <= 0.25 THEN (k - 0.1::DOUBLE) / 0.15::DOUBLE WHEN k <= 0.45 THEN (0.45::DOUBLE - k) / 0.2::DOUBLE WHEN k <= 0.65 THEN (0.65::DOUBLE - k) / 0.2::DOUBLE ELSE 0 END::DOUBLE AS key_moderate,
  CASE WHEN k <= 0.25 THEN 0 WHEN k <= 0.45 THEN (k - 0.25::DOUBLE) / 0.2::DOUBLE WHEN k <= 0.65 THEN (k - 0.45::DOUBLE) / 0.2::DOUBLE ELSE 1 END::DOUBLE AS key_strong,
  CASE c WHEN 'Low' THEN 1 WHEN 'Medium' THEN 0 WHEN 'High' THEN 0 ELSE 0.2 END::DOUBLE AS cpx_simple, CASE c WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 0 ELSE 0.8 END::DOUBLE AS cpx_moderate,
  CASE c WHEN 'Low' THEN 0 WHEN 'Medium' THEN 0 WHEN 'High' THEN 1 ELSE 0.2 END::DOUBLE AS cpx_complex,
  CASE WHEN f <= 0.15 THEN 1 WHEN f <= 0.4 THEN (0.4::DOUBLE - f) / 0.25::DOUBLE ELSE 0 END::DOUBLE AS fit_poor,
  CASE WHEN f <= 0.15 THEN 0 WHEN f <= 0.4 THEN (f - 0.15::DOUBLE) / 0.25::DOUBLE WHEN f <= 0.65 THEN 1 WHEN f <= 1 THEN (1 - f) / 0.35::DOUBLE ELSE 0 END::DOUBLE AS fit_good,
  CASE WHEN f <= 0.65 THEN 0 WHEN f <= 1 THEN (f - 0.65::DOUBLE) / 0.35::DOUBLE ELSE 1 END::DOUBLE AS fit_excellent FROM i)"""
INFER_SQL = f"""{MEMBER_SQL},
st AS (SELECT *, least(sem_high, key_strong) AS r1, least(sem_high, fit_excellent) AS r2, least(sem_medium, key_moderate, fit_good) AS r3, least(sem_medium, key_strong) AS r4,
  fit_poor AS r6, least(cpx_complex, sem_high) AS r7, least(cpx_simple, sem_high) AS r8,
  greatest(least(sem_high * 0.6::DOUBLE + sem_medium * 0.3::DOUBLE + key_strong * 0.5::DOUBLE + key_moderate * 0.2::DOUBLE + fit_excellent * 0.4::DOUBLE + fit_good * 0.2::DOUBLE, 0.7::DOUBLE), 0.1::DOUBLE) AS d FROM m),
fi AS (SELECT *, CASE WHEN r6 > 0.7 THEN r6 ELSE 0 END::DOUBLE AS l, CASE WHEN r8 > 0.4 THEN r8 ELSE 0 END::DOUBLE AS me,
  greatest(CASE WHEN r3 > 0.2 THEN r3 ELSE 0 END, CASE WHEN r4 > 0.2 THEN r4 ELSE 0 END, CASE WHEN r7 > 0.3 THEN r7 ELSE 0 END)::DOUBLE AS h,
  greatest(CASE WHEN r1 > 0.35 THEN r1 ELSE 0 END, CASE WHEN r2 > 0.4 THEN r2 ELSE 0 END)::DOUBLE AS vh,
  (r1 > 0.35)::INT + (r2 > 0.4)::INT + (r3 > 0.2)::INT + (r4 > 0.2)::INT + (r6 > 0.7)::INT + (r7 > 0.3)::INT + (r8 > 0.4)::INT AS fired FROM st),
o AS (SELECT *, greatest(l, me, h, vh) < 0.5 AS weak FROM fi),
out AS (SELECT id, CASE WHEN weak AND d <= 0.35 THEN greatest(l, CASE WHEN d > 0.2 THEN d ELSE 0.15 END) ELSE l END::DOUBLE AS out_low,
  CASE WHEN weak AND d > 0.35 AND d <= 0.55 THEN greatest(me, d) ELSE me END AS out_medium, CASE WHEN weak AND d > 0.55 THEN greatest(h, d) ELSE h END AS out_high, vh AS out_very_high, fired + weak::INT AS n_fired FROM o),
z AS (SELECT *, out_low + out_medium + out_high + out_very_high AS w, greatest(out_low, out_medium, out_high, out_very_high) AS top FROM out)"""


def scored(spark, sf_dir):
    p, n = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        p.alias("id"), (p * 37 % 101 / 100).alias("semantic"), (n * 53 % 101 / 100).alias("keyword"), (p * 11 % 101 / 100).alias("fit"),
        F.element_at(F.array(*[F.lit(x) for x in ("Low", "Medium", "High", "Very High")]), n % 4 + 1).alias("complexity"),
    )


COLUMNS = ["sem_low", "sem_medium", "sem_high", "key_weak", "key_moderate", "key_strong", "cpx_simple", "cpx_moderate", "cpx_complex", "fit_poor", "fit_good", "fit_excellent"]


@query(f"WITH {MEMBER_SQL} SELECT id, " + ", ".join(f"round({c}, 9) AS {c}" for c in COLUMNS) + " FROM m")
def fuzzy_membership(spark, sf_dir):
    return fz.membership(scored(spark, sf_dir)).select("id", *[F.round(c, 9).alias(c) for c in COLUMNS])


@query(f"""WITH {INFER_SQL} SELECT id, round(out_low, 9) AS out_low, round(out_medium, 9) AS out_medium, round(out_high, 9) AS out_high, round(out_very_high, 9) AS out_very_high, n_fired::INTEGER AS n_fired,
  round(CASE WHEN w < 0.3 THEN greatest(0.1::DOUBLE, (out_low * 0.1::DOUBLE + out_medium * 0.4::DOUBLE + out_high * 0.7::DOUBLE + out_very_high * 0.9::DOUBLE) / w)
    ELSE (out_low * 0.1::DOUBLE + out_medium * 0.4::DOUBLE + out_high * 0.7::DOUBLE + out_very_high * 0.9::DOUBLE) / w END, 9) AS preliminary,
  round((out_low * 0.15::DOUBLE + out_medium * 0.45::DOUBLE + out_high * 0.8::DOUBLE + out_very_high * 0.95::DOUBLE) / w, 9) AS relevance, round(least(top * 0.9::DOUBLE + 0.1::DOUBLE, 0.95::DOUBLE), 9) AS certainty,
  CASE WHEN out_low = top THEN 0.2 WHEN out_medium = top THEN 0.5 WHEN out_high = top THEN 0.75 ELSE 0.85 END::DOUBLE AS peak FROM z""")
def fuzzy_infer_defuzz(spark, sf_dir):
    out = fz.defuzzified(fz.inferred(fz.membership(scored(spark, sf_dir))))
    r = lambda c: F.round(c, 9).alias(c)
    return out.select("id", *[r(f"out_{s}") for s in fz.SETS], F.size("firings").alias("n_fired"), r("preliminary"), r("relevance"), r("certainty"), "peak")


def _label(names: list[str]) -> str:
    most = f"greatest({', '.join(names)})"
    return "CASE " + " ".join(f"WHEN {n} = {most} THEN '{n.split('_', 1)[1]}'" for n in names) + " END"


GROUPS = {"sem": ["low", "medium", "high"], "key": ["weak", "moderate", "strong"], "cpx": ["simple", "moderate", "complex"], "fit": ["poor", "good", "excellent"]}


@query(f"WITH {MEMBER_SQL} SELECT id, " + ", ".join(f"{_label([f'{p}_{n}' for n in names])} AS {p}_level" for p, names in GROUPS.items()) + " FROM m")
def fuzzy_labels(spark, sf_dir):
    m = fz.membership(scored(spark, sf_dir))
    return m.select("id", *[fz.dominant(p, names).alias(f"{p}_level") for p, names in GROUPS.items()])


@query(f"""WITH {INFER_SQL}, r AS (SELECT unnest([1, 2, 3, 4, 6, 7, 8]) AS rule, unnest([r1 > 0.35, r2 > 0.4, r3 > 0.2, r4 > 0.2, r6 > 0.7, r7 > 0.3, r8 > 0.4]) AS on_, unnest([r1, r2, r3, r4, r6, r7, r8]) AS s FROM st)
SELECT rule, count(*)::BIGINT AS n, round(avg(s), 9) AS mean_strength FROM r WHERE on_ GROUP BY rule""")
def fuzzy_rule_stats(spark, sf_dir):
    fired = fz.inferred(fz.membership(scored(spark, sf_dir))).select(F.explode("firings").alias("f")).select("f.*")
    number = F.create_map(*[c for r, (_, _, text) in fz.RULES.items() for c in (F.lit(text), F.lit(r))])
    named = fired.withColumn("rule", F.try_element_at(number, F.col("rule"))).filter("rule is not null")
    return named.groupBy("rule").agg(F.count("*").alias("n"), F.round(F.avg("strength"), 9).alias("mean_strength"))


@query(f"""WITH {INFER_SQL}, x AS (SELECT (out_low * 0.15::DOUBLE + out_medium * 0.45::DOUBLE + out_high * 0.8::DOUBLE + out_very_high * 0.95::DOUBLE) / w AS v, least(top * 0.9::DOUBLE + 0.1::DOUBLE, 0.95::DOUBLE) AS c FROM z)
SELECT count(*)::BIGINT AS n, round(avg(c), 9) AS certainty, count(*) FILTER (round(v, 9) < 0.4)::BIGINT AS low, count(*) FILTER (round(v, 9) >= 0.4 AND round(v, 9) < 0.8)::BIGINT AS medium, count(*) FILTER (round(v, 9) >= 0.8)::BIGINT AS high, round(min(v), 9) AS least, round(max(v), 9) AS most FROM x""")
def defuzz_stats(spark, sf_dir):
    out = fz.defuzzified(fz.inferred(fz.membership(scored(spark, sf_dir)))).withColumn("v", F.round("relevance", 9))
    return out.agg(
        F.count("*").alias("n"), F.round(F.avg("certainty"), 9).alias("certainty"), F.count_if(F.col("v") < 0.4).alias("low"),
        F.count_if((F.col("v") >= 0.4) & (F.col("v") < 0.8)).alias("medium"), F.count_if(F.col("v") >= 0.8).alias("high"), F.min("v").alias("least"), F.max("v").alias("most"),
    )


@query("""WITH t AS (SELECT p_partkey AS id, p_type, p_brand, ['Low', 'Medium', 'High', 'Very High'][(p_size % 4 + 1)::INTEGER] AS c FROM part)
SELECT id, round(greatest(0, least(1, 0.5 + CASE WHEN len(list_filter(string_split(p_type, ' '), lambda x: contains(lower(x), 'bra'))) > 0 THEN 0.3 ELSE -0.1 END
  + CASE WHEN lower(p_brand) = 'creational' THEN 0.2 ELSE 0 END + CASE WHEN lower(c) = 'low' THEN 0.1 ELSE 0 END)), 9)::DOUBLE AS fit FROM t""")
def contextual_fit(spark, sf_dir):
    level = F.element_at(F.array(*[F.lit(x) for x in ("Low", "Medium", "High", "Very High")]), F.col("p_size") % 4 + 1)
    fit = fz.contextual_fit(F.lit("create factory now"), F.lit("Brass"), F.split("p_type", " "), F.col("p_brand"), level)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(fit, 9).alias("fit"))
