import random

import pytest
from pyspark.sql import functions as F

from dipwatch.functions.minutes import calendar, with_trailing
from dipwatch.operators.onset import SERIES, collect_lookback, with_onset
from dipwatch.operators.rollup import decline_rollup, first_write, merge_rollups, minute_rollup
from dipwatch.operators.series import carried_rates
from dipwatch.operators.slices import conversion_series
from dipwatch.operators.streaks import pending_at, pending_spans, promoted, streaks
from dipwatch.plans.detect import detect
from dipwatch.streaming.persistence import carry_over, continue_streaks
from tests.grids import NOON, frame, key, row

ADYEN = key(country="BR", merchant_id="BR_STORE_01", provider_id="adyen")


def minutes(spec, start=NOON):
    """spec: list of (adyen n, adyen k) per minute, siblings healthy."""
    rows = []
    for i, (n, k) in enumerate(spec):
        rows += [row(n, k, "adyen", minute=start + i), row(100, 95, "stripe", minute=start + i),
                 row(100, 95, "mercado_pago", minute=start + i)]
    return rows


def run(spark, rows, merchants, coverage):
    return detect(frame(spark, rows), merchants, coverage)


def test_three_windows_confirm_and_later_ones_confirm_again(spark, merchants, coverage):
    found = run(spark, minutes([(100, 95), (100, 20), (100, 20), (100, 20), (100, 20)]), merchants, coverage)
    hits = found.signals.where(F.col("cell_key") == ADYEN).orderBy("minute").collect()
    assert [(r.minute - NOON, r.consecutive_windows) for r in hits] == [(3, 3), (4, 4)]
    assert all(r.started_minute == NOON + 1 and r.started_at_exact for r in hits)
    assert {r.expected_source for r in hits} == {"cross_sectional"}


def test_recovery_clears_a_streak_and_a_missing_minute_does_not(spark, merchants, coverage):
    rows = minutes([(100, 20), (100, 95), (100, 20), (100, 20)])
    assert run(spark, rows, merchants, coverage).signals.where(F.col("cell_key") == ADYEN).count() == 0
    rows = minutes([(100, 20), (100, 20)]) + minutes([(100, 20)], NOON + 3)
    hit = run(spark, rows, merchants, coverage).signals.where(F.col("cell_key") == ADYEN).collect()
    assert [(r.minute, r.consecutive_windows) for r in hit] == [(NOON + 3, 3)]


def test_thin_drop_is_read_again_over_five_minutes(spark, merchants, coverage):
    found = run(spark, minutes([(8, 1)] * 6), merchants, coverage)
    last = found.signals.where((F.col("cell_key") == ADYEN) & (F.col("minute") == NOON + 5)).first()
    assert (last.window_used, last.attempts, last.consecutive_windows) == ("5m", 40, 3)


def test_five_thin_minutes_stay_a_gap(spark, merchants, coverage):
    found = run(spark, minutes([(1, 0)] * 5), merchants, coverage)
    gap = found.gaps.where((F.col("cell_key") == ADYEN) & (F.col("minute") == NOON + 4)).first()
    assert gap.attempts == 5
    assert found.signals.where(F.col("cell_key") == ADYEN).count() == 0


def test_thin_healthy_slice_is_no_gap(spark, merchants, coverage):
    rows = [row(29, 29, "adyen"), row(400, 340, "stripe"), row(400, 340, "mercado_pago")]
    assert run(spark, rows, merchants, coverage).gaps.where(F.col("cell_key") == ADYEN).count() == 0


def test_uncovered_provider_counts_as_sibling_but_is_not_tested(spark, merchants, coverage):
    rows = [row(100, 30, "adyen"), row(100, 90, "stripe"), row(100, 0, "unlisted")]
    found = run(spark, rows, merchants, coverage).readings
    got = {r.cell_key: r.expected for r in found.where("split = 'provider'").collect()}
    assert key(country="BR", merchant_id="BR_STORE_01", provider_id="unlisted") not in got
    assert got[ADYEN] == pytest.approx(90 / 200)


def fold(states, windows=3):
    """Brute force: one slice's (minute, state) readings in order."""
    count, first, out = 0, None, []
    for minute, state in states:
        if state == "MATERIAL_DROP":
            count, first = count + 1, first if count else minute
        else:
            count, first = 0, None
        out.append((minute, count, first))
    return out


def test_streaks_equal_a_plain_fold_across_day_blocks(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for c in range(40):
        at = sorted(rng.sample(range(60), rng.randint(1, 45)))
        states = [(m, rng.choice(["MATERIAL_DROP"] * 4 + ["HEALTHY", "MONITORING"])) for m in at]
        rows += [(f"c{c}", m, s) for m, s in states]
        expected[f"c{c}"] = fold(states)
    df = spark.createDataFrame(rows, "cell_key string, minute bigint, state string")
    for block in (7, 1440):
        got = streaks(df, block=block)
        seen = {(r.cell_key, r.minute): (r.streak, r.first_minute) for r in got.collect()}
        assert seen == {(c, m): (n, f) for c, out in expected.items() for m, n, f in out}
        spans = pending_spans(got, block=block)
        open_at_30 = {r.cell_key for r in pending_at(spans, F.lit(30)).collect()}
        want = {c for c, out in expected.items() if [x for x in out if x[0] <= 30] and [x for x in out if x[0] <= 30][-1][1] in (1, 2)}
        assert open_at_30 == want
    # Continuing from stored state gives the same streaks.
    early, late = df.where("minute < 25"), df.where("minute >= 25")
    none = spark.createDataFrame([], "cell_key string, streak bigint, first_minute bigint")
    state = carry_over(none, continue_streaks(early, none))
    assert {r.cell_key for r in state.collect()} == {c for c, out in expected.items() if [x for x in out if x[0] < 25] and [x for x in out if x[0] < 25][-1][1]}
    again = {(r.cell_key, r.minute): (r.streak, r.first_minute) for r in continue_streaks(late, state).collect()}
    assert again == {k: v for k, v in seen.items() if k[1] >= 25}


def test_blocked_windows_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [("a" if rng.random() < 0.5 else "b", m, rng.randint(0, 9)) for m in rng.sample(range(200), 120)]
    df = spark.createDataFrame(rows, "k string, minute bigint, v bigint")
    got = with_trailing(df, ["k"], 12, {"past": (F.sum("v"), 12, 1), "wide": (F.sum("v"), 4, 0)}, block=10)
    for r in got.collect():
        past = [v for k, m, v in rows if k == r.k and r.minute - 12 <= m <= r.minute - 1]
        wide = [v for k, m, v in rows if k == r.k and r.minute - 4 <= m <= r.minute]
        assert (r.past, r.wide) == (sum(past) if past else None, sum(wide))
    assert got.count() == len(rows)


def onset_by_hand(spine, seen, minute, limit):
    run = []
    for m in sorted((s for s in spine if minute - 120 <= s <= minute), reverse=True):
        n, k = seen.get(m, (0, 0))
        if n >= 30 and k / n >= limit:
            break
        run.insert(0, m)
    if len(run) < 3:
        return minute, False
    return run[0], all(seen.get(m, (0, 0))[0] >= 30 for m in run)


def test_onset_equals_a_walk_back(spark):
    rng = random.Random(11)
    base = 29801640 - 29801640 % 1440 + 30  # early in a day, so the look-back crosses midnight
    spine = sorted(rng.sample(range(base - 200, base + 60), 180))
    seen = {m: (n, rng.randint(0, n)) for m in rng.sample(spine, 120) for n in [rng.choice([10, 40, 60])]}
    rows = [(m, "M", "p", "BR", "CARD", "i", *nk) for m, nk in seen.items()]
    rows += [(m, "OTHER", "p", "BR", "CARD", "i", 1, 1) for m in spine]
    r = spark.createDataFrame(rows, "minute bigint, merchant_id string, provider_id string, country string, payment_method string,"
                                    " issuer_id string, attempts bigint, approved bigint")
    asked = [m for m in spine if m >= base]
    req = spark.createDataFrame([(str(m), m, "M", "p", "BR", "CARD", "i", 0.4, 3.0) for m in asked],
                                "request_id string, minute bigint, merchant_id string, provider_id string, country string,"
                                " payment_method string, issuer_id string, expected double, delta_pp double")
    got = with_onset(collect_lookback(req, r.where("merchant_id = 'M'"), SERIES), calendar(r)).collect()
    for x in got:
        assert (x.started_minute, x.started_at_exact) == onset_by_hand(spine, seen, x.minute, 0.4 - 0.03)
    assert len(got) == len(asked)


def tx(spark, rows):
    return spark.createDataFrame(rows, "transaction_id bigint, created_at timestamp, merchant_id string, provider_id string, country"
                                       " string, payment_method string, issuer_id string, status string, decline_code string,"
                                       " amount_minor bigint, amount_usd_minor bigint")


def test_rollup_and_merge(spark):
    import datetime as dt
    at = dt.datetime(2026, 8, 30, 14, 6, 7)
    base = ("BR_STORE_01", "stripe", "BR", "CARD", "itau")
    a, b = (1, at, *base, "SUCCESS", None, 1000, 200), (2, at, *base, "DECLINED", "05", 2000, 400)
    r = minute_rollup(tx(spark, [a, b]))
    got = r.first()
    assert (got.attempts, got.approved, got.amount_minor_sum, got.amount_usd_sum, got.approved_usd_sum) == (2, 1, 3000, 600, 200)
    assert decline_rollup(tx(spark, [a, b])).first().declines == 1
    merged = merge_rollups(minute_rollup(tx(spark, [a])), minute_rollup(tx(spark, [b])))
    assert merged.exceptAll(r).count() == 0 and merged.count() == 1
    assert first_write(tx(spark, [a, a, b]), ["transaction_id"], ["amount_minor"]).count() == 2


def test_series_is_zero_filled_over_all_traffic(spark):
    rows = [row(10, 9, "stripe", minute=NOON), row(10, 9, "adyen", minute=NOON + 1)]
    from dipwatch.functions.minutes import bucket_of
    df = frame(spark, rows)
    out = conversion_series(df, {"provider_id": "stripe"}, bucket_of(F.lit(NOON)), bucket_of(F.lit(NOON + 2))).orderBy("bucket").collect()
    assert [(r.attempts, r.rate) for r in out] == [(10, 0.9), (0, None)]
    carried = carried_rates(df.select("bucket", "provider_id", "attempts", "approved"), 60).orderBy("provider_id", "bucket").collect()
    assert [r.rate for r in carried] == [0.9, 0.9, 0.9, 0.9]


def test_promotion_needs_three(spark):
    df = spark.createDataFrame([("c", m, "MATERIAL_DROP") for m in range(2)], "cell_key string, minute bigint, state string")
    assert promoted(streaks(df)).count() == 0
