"""Feature operators on small hand-built events."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from strictasof.operators import features as X
from strictasof.operators import quality as Q
from strictasof.operators import speed
from strictasof.plans import matrix
from tests.conftest import D, race, runner


def frame(tables):
    return matrix.entry_frame(tables)


def test_lead_quantile_tells_missing_history_from_missing_corner(event_tables, by_key):
    races = [race(1, D[0], n_starters=4), race(2, D[1], corner_nos=[3, 4]), race(3, D[2], n_starters=4), race(4, D[3])]
    runners = [runner(1, 1, corners=[2, 2, 2, 2]), runner(2, 2, corners=[1, 1]), runner(3, 1, corners=[4, 4, 4, 4]),
               runner(3, 2), runner(4, 1), runner(4, 3)]
    out = by_key(X.add_lead_quantile(frame(event_tables(races, runners))), "f101", "f101_unavailable")
    assert out[(4, 1)] == (pytest.approx(0.5 + 0.25 * 0.5), 0)  # quartile of 2/4 and 4/4
    assert out[(3, 2)] == (None, 1)  # a past event, but without a first corner
    assert out[(4, 3)] == (None, 0)  # no past event at all


def test_target_encode_shrinks_toward_the_condition(event_tables, by_key):
    races = [race(1, D[0], n_starters=2), race(2, D[1], n_starters=2), race(3, D[1])]
    runners = [runner(1, 1, jockey_id=7, finish_pos=1), runner(1, 2, jockey_id=8, finish_pos=2),
               runner(2, 1, jockey_id=7), runner(2, 2, jockey_id=None), runner(3, 3, jockey_id=9)]
    out = by_key(X.add_partner_course_encoding(frame(event_tables(races, runners))), "f704", "f704_unavailable")
    assert out[(1, 1)] == (0.5, 0)  # nothing before: the neutral value
    assert out[(2, 1)] == (pytest.approx((1 * 0.5 + 5 * 0.75) / 6), 0)
    assert out[(2, 2)] == (None, 1)
    assert out[(3, 3)] == (pytest.approx(0.75), 0)  # unseen partner: the condition's own mean


def test_previous_event_family(event_tables, by_key):
    races = [race(1, D[0], grade="G2", distance=1200, course="中山"), race(2, D[0], course="京都"), race(3, D[14], direction=None)]
    runners = [runner(1, 1, finish_pos=5, margin="1.1/2", jockey_id=3, last_3f=34.0), runner(1, 2, last_3f=36.0, finish_pos=None, status="競走中止"),
               runner(2, 9), runner(3, 1, jockey_id=4), runner(3, 2, jockey_id=1), runner(3, 5)]
    entries = X.with_last_3f_rank(frame(event_tables(races, runners)))
    out = X.add_features(entries, [X.previous_result(), X.recency(), X.partner_change(), X.condition_change(), X.career_rates()])
    got = by_key(out, "f601_finish_pos_prev", "f601_margin_prev", "f601_last3f_rank_prev", "f602_weeks_since_last", "f602_prev_grade",
                 "f702_jockey_changed", "f807_distance_diff", "f807_direction_changed", "f809_top3_rate")
    assert got[(3, 1)] == (5.0, 1.5, 0.5, 2.0, "G2", 1, 400.0, 1.0, 0.0)
    assert got[(3, 2)][0] is None and got[(3, 2)][5] == 0 and got[(3, 2)][8] is None
    assert got[(3, 5)] == (None,) * 9
    flags = by_key(out, "f601_margin_prev_unavailable", "f602_prev_grade_unavailable", "f702_jockey_changed_unavailable")
    assert flags[(3, 2)] == (0, 0, 0) and flags[(3, 5)] == (1, 1, 1)


def test_same_day_events_never_see_each_other(event_tables, by_key):
    races = [race(1, D[0], race_number=1), race(2, D[0], race_number=5, course="京都")]
    runners = [runner(1, 1, finish_pos=1), runner(2, 1, finish_pos=1)]
    out = X.add_features(frame(event_tables(races, runners)), [X.career_rates(), X.recency()])
    assert set(by_key(out, "f809_win_rate").values()) == {None}


def test_session_bias_uses_earlier_numbers_of_the_same_place_only(event_tables, by_key):
    races = [race(1, D[0], race_number=1, n_starters=4), race(2, D[0], race_number=2, n_starters=4),
             race(3, D[0], race_number=3), race(4, D[0], race_number=1, course="京都"), race(5, D[1], race_number=9)]
    runners = [runner(1, 1, finish_pos=1, corners=[1, 2]), runner(1, 2, finish_pos=4, corners=[4, 4]),
               runner(2, 3, finish_pos=3, corners=[3, 4]), runner(3, 4, corners=None), runner(4, 5), runner(5, 6)]
    out = by_key(speed.add_session_bias(frame(event_tables(races, runners))), "f501", "f501_unavailable")
    assert out[(1, 1)] == (None, 1)
    assert out[(2, 3)] == (0.5, 0)
    assert out[(3, 4)] == (0.75, 0)  # mean of 2/4 and 4/4
    assert out[(4, 5)] == (None, 1) and out[(5, 6)] == (None, 1)


def test_main_partner_ties_go_to_the_lowest_id(event_tables, by_key):
    races = [race(i, D[i]) for i in range(1, 6)]
    runners = [runner(1, 1, jockey_id=8), runner(2, 1, jockey_id=5), runner(3, 1, jockey_id=8), runner(4, 1, jockey_id=5),
               runner(5, 1, jockey_id=5), runner(3, 2, jockey_id=8, trainer_id=2), runner(5, 3, trainer_id=None)]
    out = by_key(X.add_stable_intent(frame(event_tables(races, runners))), "f703_main_jockey_flag", "f703_main_jockey_flag_unavailable")
    assert out[(1, 1)] == (None, 1) and out[(2, 1)] == (0, 0)
    assert out[(3, 1)] == (0, 0)  # one each so far: the lower id 5
    assert out[(4, 1)] == (0, 0)  # 8 leads by 2 to 1
    assert out[(5, 1)] == (1, 0) and out[(3, 2)] == (None, 1) and out[(5, 3)] == (None, 1)


def test_home_and_away(event_tables, by_key):
    races = [race(1, D[0], course="東京"), race(2, D[0], course="阪神")]
    runners = [runner(1, 1, affiliation="東"), runner(1, 2, affiliation="西"), runner(2, 3, affiliation="地"), runner(2, 4, affiliation=None)]
    out = by_key(X.add_stable_intent(frame(event_tables(races, runners))), "f703_travel_flag", "f703_travel_flag_unavailable")
    assert out == {(1, 1): (0, 0), (1, 2): (1, 0), (2, 3): (None, 1), (2, 4): (None, 1)}


def test_speed_index_by_hand(event_tables, by_key):
    races = [race(1, date(2020, 1, 5)), race(2, date(2020, 2, 9)), race(3, date(2020, 2, 9), course="京都")]
    runners = [runner(1, i, time_sec=90.0 + i) for i in range(1, 5)]  # January: mean 92.5
    runners += [runner(2, 1, time_sec=91.0), runner(2, 2, time_sec=92.0), runner(2, 3, time_sec=96.0), runner(3, 4, time_sec=99.0)]
    entries = frame(event_tables(races, runners))
    out = by_key(speed.with_speed_index(entries, min_n=4, min_session_n=2), "spd")
    sd = (1.25) ** 0.5
    assert out[(1, 1)] is None  # no earlier month
    assert out[(2, 1)] == pytest.approx(1.0 / sd) and out[(2, 2)] == pytest.approx(0.0) and out[(2, 3)] == pytest.approx(-4.0 / sd)
    assert out[(3, 4)] is None  # a session of one


def test_opponent_strength_leaves_the_own_value_out(event_tables, by_key):
    races = [race(1, D[0]), race(2, D[1])]
    runners = [runner(1, 1), runner(1, 2), runner(1, 3, status="競走中止", finish_pos=None), runner(2, 1), runner(2, 3), runner(2, 4)]
    spd = F.when(F.col("race_id") == 1, F.when(F.col("horse_id") == 1, F.lit(9.0)).when(F.col("horse_id") == 2, F.lit(1.5)))
    entries = X.with_rival_speed(frame(event_tables(races, runners)).withColumn("spd", spd))
    out = by_key(X.add_features(entries, [X.opponent_strength()]), "f806_field_mean", "f806_n", "f806_unavailable")
    assert out[(2, 1)] == (1.5, 1.0, 0)
    assert out[(2, 3)] == (None, 0.0, 0)  # did not finish before: nobody counts as met
    assert out[(2, 4)] == (None, 0.0, 0)


def test_residual_rating_takes_popularity_out(event_tables, by_key):
    races = [race(i, D[i]) for i in (1, 2, 3)]
    runners = [runner(1, 1, popularity=1, finish_pos=2), runner(2, 1, popularity=1, finish_pos=5), runner(3, 1, popularity=1), runner(3, 2, jockey_id=None)]
    out = by_key(X.add_partner_rating(frame(event_tables(races, runners))), "f701", "f701_unavailable")
    assert out[(1, 1)] == (0.0, 0) and out[(2, 1)] == (0.0, 0)
    assert out[(3, 1)] == (pytest.approx(3.0), 0)  # one residual of 5 - 2, and the overall mean is the same
    assert out[(3, 2)] == (None, 1)


def test_pace_slope_by_hand(event_tables, by_key):
    races = [race(i, D[i], n_starters=10) for i in range(1, 7)]
    runners = []
    lead = {2: 10, 3: 5, 4: 2}  # one rival per event with a known earlier ratio
    for i, rival in ((1, 2), (2, 3), (3, 4)):
        runners.append(runner(i, rival, corners=[lead[rival]] * 4))
    for i, rival, margin in ((4, 2, "2"), (5, 3, "4"), (6, 4, "1/2")):
        runners += [runner(i, 1, margin=margin), runner(i, rival)]
    entries = X.with_pace_pair(X.add_lead_quantile(frame(event_tables(races, runners))))
    pairs = {(r["race_id"], r["horse_id"]): (r["pace_x"], r["pace_y"]) for r in entries.collect()}
    assert pairs[(4, 1)] == (pytest.approx(0.0), 2.0) and pairs[(5, 1)] == (pytest.approx(0.5), 4.0)
    out = by_key(X.add_pace_aptitude(entries), "f103", "f103_unavailable")
    assert out[(5, 1)] == (None, 1)  # one pair gives no slope
    # slope 4 from two pairs; no slope is dated earlier, so the prior is 0
    assert out[(6, 1)] == (pytest.approx(2 * 4.0 / 7), 0)
    assert out[(4, 1)] == (None, 0)


def test_final_section_window(event_tables, by_key):
    races = [race(i, D[i]) for i in range(1, 9)]
    runners = [runner(i, 1, last_3f=30.0 + i if i != 2 else None) for i in range(1, 9)]
    entries = X.with_last_3f_rank(frame(event_tables(races, runners)))
    out = by_key(X.add_final_section(entries), "last3f_all", "last3f_recent", "last3f_rank_in_race", "last3f_recent_unavailable")
    assert out[(1, 1)] == (None, None, None, 0)
    past = [31, 33, 34, 35, 36, 37]
    mu = sum(past) / 6
    assert out[(8, 1)] == (pytest.approx((sum(past) + 5 * mu) / 11), pytest.approx((sum(past[1:]) + 5 * mu) / 10), pytest.approx(0.5), 0)


def test_features_do_not_depend_on_the_cutoff(event_tables):
    races = [race(i, D[i], n_starters=2) for i in range(1, 12)]
    runners = [runner(i, 1 + (i + j) % 4, finish_pos=1 + j, jockey_id=1 + i % 3, popularity=1 + j) for i in range(1, 12) for j in range(2)]
    entries = frame(event_tables(races, runners))
    def build(rows):
        rows = X.add_partner_rating(X.add_course_aptitude(X.add_partner_course_encoding(rows)))
        return X.add_features(rows, [X.career_rates()]).select("race_id", "horse_id", "f701", "f704", "f802", "f809_win_rate")
    early, late = build(entries.where(F.col("date") < F.lit(D[7]))), build(entries)
    assert Q.differing_rows(early, late, ["race_id", "horse_id"]).count() == 0
    leaky = build(entries.withColumn("date", F.lit(D[20]))).unionByName(late.limit(0))
    assert Q.differing_rows(leaky, late, ["race_id", "horse_id"]).count() > 0


def test_matrix_rows_and_columns(event_tables):
    races = [race(i, date(2020, 1 + i // 6, 1 + i), n_starters=3) for i in range(1, 12)]
    runners = [runner(i, 1 + (i + j) % 5, finish_pos=1 + j, time_sec=90.0 + i + j, status="出走取消" if j == 3 else "出走") for i in range(1, 12) for j in range(4)]
    tables = event_tables(races, runners)
    out = matrix.feature_matrix(tables, as_of=date(2020, 12, 31), min_session_n=1)
    rows = out.collect()
    assert len(rows) == 33 == len({(r["race_id"], r["horse_id"]) for r in rows})
    assert {"f101", "f103", "f104", "f202_sire", "last3f_all", "fspd_best", "f501", "f601_margin_prev", "f701", "f703_main_jockey_flag",
            "f801", "f802", "f806_field_mean", "f807_prev_course", "f809_win_rate_z", "f302_unavailable", "f701_rank"} <= set(out.columns)
    assert not {c for c in out.columns if c.endswith("_z_z") or c.startswith("f103_z_") or c == "f501_z" or c == "sire_id_z"}
    assert Q.forbidden_columns(out, ["finish_pos", "odds_win", "popularity", "time_sec"]) == []
    assert all(0 < r["f802_rank"] <= 1 for r in rows)
