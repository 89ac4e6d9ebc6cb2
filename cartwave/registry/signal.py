"""Registered positioning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cartwave.functions.columns import drop_containing, zero_nulls
from cartwave.functions.geo import bounding_box, grid_of, grid_spec, haversine
from cartwave.operators import metrics, ranking, sampling
from cartwave.operators import stations as st
from cartwave.plans import positioning as pos
from cartwave.registry import signal_sql as q
from cartwave.registry.base import Registry, rounded, sql_double, sql_whole
from cartwave.session import cut
from cartwave.sources.reports import SLOTS, star_reports, star_stations

SPLITS = 3
SLOT_IDS = range(1, SLOTS + 1)
POSITIONS = [f"{c}_{i}" for i in SLOT_IDS for c in ("Longitude", "Latitude")]


def extent_of(spark, sf_dir) -> DataFrame:
    """The reports' positions alone."""
    return star_reports(spark, sf_dir, slots=()).select("Latitude", "Longitude")


def table_of(spark, sf_dir) -> DataFrame:
    """Reports joined to their stations, nulls kept."""
    reports = st.with_cells(
        star_reports(spark, sf_dir), extent=extent_of(spark, sf_dir)
    ).withColumnsRenamed({"Longitude": "Longitude_m", "Latitude": "Latitude_m"})
    return st.with_positions(reports, star_stations(spark, sf_dir))


def main_table(spark, sf_dir) -> DataFrame:
    """Reports joined to their main station only."""
    reports = star_reports(spark, sf_dir, slots=[1]).select(
        "row_id", "RNCID_1", "CellID_1",
        F.col("Longitude").alias("Longitude_m"), F.col("Latitude").alias("Latitude_m"))
    return st.with_positions(reports, star_stations(spark, sf_dir), slots=[1])


def training_of(spark, sf_dir) -> DataFrame:
    return st.training_table(
        star_reports(spark, sf_dir), star_stations(spark, sf_dir), extent=extent_of(spark, sf_dir))


def errors_of(spark, sf_dir, wide=False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of all splits, scored test records, and the error table.

    The rows are stored once, because several passes read them; ``wide`` keeps all
    features.
    """
    table = training_of(spark, sf_dir) if wide else main_table(spark, sf_dir)
    rows = cut(pos.split_rows(table, SPLITS))
    scored = pos.mean_offset_errors(rows)
    return rows, scored, pos.error_table(scored)


def register(r: Registry) -> None:
    def add(name, build, sql, places=3):
        r.add(name, lambda spark, sf: rounded(build(spark, sf), places), sql)

    def select(ctes, cols, source, tail=""):
        return f"WITH {ctes} SELECT {', '.join(cols)} FROM {source} {tail}"

    def wholes(names):
        return [sql_whole(n, n) for n in names]

    def doubles(names, places):
        return [sql_double(n, n, places) for n in names]

    STATION = ["RNCID_1", "CellID_1"]
    keys = [f"{c}_{i}" for i in SLOT_IDS for c in ("RNCID", "CellID")]
    levels = [f"{c}_{i}" for i in SLOT_IDS for c in ("RSSI", "AsuLevel", "SignalLevel")]

    # sources, grid and geo functions
    add("src2_reports",
        lambda s, d: star_reports(s, d).select("row_id", "IMSI", "Num_connected", "Latitude",
                                               "Longitude", *keys, *levels),
        select(q.REPORTS, ["row_id", "IMSI", *wholes(["Num_connected", *keys]),
                           *doubles(["Latitude", "Longitude", *levels], 9)], "reports"), 9)
    add("src2_stations", star_stations,
        select(q.STATIONS, ["RNCID", "CellID", *doubles(["Longitude", "Latitude"], 9)], "stations"), 9)
    add("agg15_bounding_box",
        lambda s, d: bounding_box(extent_of(s, d), "Latitude", "Longitude"),
        select(q.GRID, [sql_double(a, b, 9) for a, b in
                        (("la0", "lat_min"), ("la1", "lat_max"), ("lo0", "lon_min"), ("lo1", "lon_max"))],
               "box"), 9)
    add("geo2_grid_size",
        lambda s, d: grid_spec(extent_of(s, d), "Latitude", "Longitude").select("grid_rows", "grid_cols"),
        select(q.GRID, ["rws AS grid_rows", "cls AS grid_cols"], "grid"))
    add("geo1_haversine",
        lambda s, d: table_of(s, d).select("row_id", *[
            haversine(F.col("Latitude_m"), F.col("Longitude_m"),
                      F.col(f"Latitude_{i}"), F.col(f"Longitude_{i}")).alias(f"metres_{i}") for i in SLOT_IDS]),
        select(q.JOINED, ["row_id", *[
            sql_double(q.hav("Latitude_m", "Longitude_m", f"Latitude_{i}", f"Longitude_{i}"),
                       f"metres_{i}", 3) for i in SLOT_IDS]], "joined"))
    add("geo2_grid_label",
        lambda s, d: st.with_cells(star_reports(s, d, slots=())).select("row_id", "Target"),
        select(q.GRID, ["row_id", f"{q.cell('Latitude', 'Longitude')} AS Target"], "reports, grid"))

    def station_cells(s, d):
        grid = grid_of(extent_of(s, d), "Latitude", "Longitude")
        return star_stations(s, d).select(
            "RNCID", "CellID", grid.cell_of(F.col("Latitude"), F.col("Longitude")).alias("cell"))

    add("geo3_cell_of_point", station_cells,
        select(q.GRID, ["RNCID", "CellID", f"{q.cell('Latitude', 'Longitude')} AS cell"], "stations, grid"))

    def centres(s, d, drift=False):
        rep = star_reports(s, d, slots=())
        grid = grid_of(rep, "Latitude", "Longitude")
        lat, lon = grid.centre_of(F.col("Target"), drift)
        return st.with_cells(rep).select("row_id", "Target", lat.alias("lat"), lon.alias("lon"))

    labelled = f"(SELECT row_id, {q.cell('Latitude', 'Longitude')} AS Target FROM reports, grid) z, grid"
    for name, drift in (("geo4_cell_centre", False), ("geo4_cell_centre_true_division", True)):
        la, lo = q.centre("Target", drift)
        add(name, lambda s, d, drift=drift: centres(s, d, drift),
            select(q.GRID, ["row_id", "Target", sql_double(la, "lat", 9), sql_double(lo, "lon", 9)], labelled), 9)
    add("geo5_relative_position",
        lambda s, d: st.with_offsets(main_table(s, d)).select("row_id", *pos.OFFSETS),
        select(q.OFFSETS, ["row_id", sql_double("dlat", "relative_latitude", 9),
                           sql_double("dlon", "relative_longitude", 9)], "offs"), 9)
    add("geo6_absolute_position",
        lambda s, d: st.with_absolute(st.with_offsets(main_table(s, d)), *pos.OFFSETS)
        .select("row_id", "pred_latitude", "pred_longitude"),
        select(q.OFFSETS, ["row_id", sql_double("dlat + Latitude_1", "pred_latitude", 9),
                           sql_double("dlon + Longitude_1", "pred_longitude", 9)], "offs"), 9)

    # station joins and fills
    add("jn6_station_lookup", lambda s, d: table_of(s, d).select("row_id", *POSITIONS),
        select(q.JOINED, ["row_id", *doubles(POSITIONS, 9)], "joined"), 9)

    def by_shuffle(s, d):
        return st.with_positions(star_reports(s, d), star_stations(s, d), small_rows=0).select(
            "row_id", *POSITIONS)

    add("jn6_station_lookup_shuffled", by_shuffle,
        select(q.JOINED, ["row_id", *doubles(POSITIONS, 9)], "joined"), 9)
    filled = [f"{c}_{i}" for i in range(2, SLOTS + 1) for c in ("Latitude", "Longitude", "RSSI")]
    filled_keys = [f"{c}_{i}" for i in range(2, SLOTS + 1) for c in ("RNCID", "CellID")]

    def from_main(name):
        stem, i = name.rsplit("_", 1)
        return (f"CASE WHEN Latitude_{i} IS NULL OR Longitude_{i} IS NULL "
                f"THEN {stem}_1 ELSE {name} END")

    add("prj7_fill_from_main",
        lambda s, d: st.fill_from_main(table_of(s, d)).select("row_id", *filled_keys, *filled),
        select(q.JOINED, ["row_id", *[sql_whole(from_main(n), n) for n in filled_keys],
                          *[sql_double(from_main(n), n, 9) for n in filled]], "joined"), 9)
    add("prj6_fill_with_zero",
        lambda s, d: zero_nulls(table_of(s, d), keep=("row_id",)).select("row_id", *filled_keys, *filled),
        select(q.JOINED, ["row_id", *[sql_whole(f"coalesce({n}, 0)", n) for n in filled_keys],
                          *[sql_double(f"coalesce({n}, 0)", n, 9) for n in filled]], "joined"), 9)
    kept = ["Num_connected", "Latitude_m", "Longitude_m", "Target",
            *[f"RSSI_{i}" for i in SLOT_IDS], *POSITIONS]
    whole_kept = {"Num_connected", "Target"}
    add("prj3_drop_by_fragment",
        lambda s, d: drop_containing(training_of(s, d), pos.NOT_FEATURES),
        select(q.JOINED, ["row_id", *[
            sql_whole(c, c) if c in whole_kept else sql_double(f"coalesce({c}, 0)", c, 9) for c in kept]],
            "joined"), 9)
    add("prj9_distinct_stations", lambda s, d: st.distinct_stations(main_table(s, d)),
        select(q.JOINED, ["DISTINCT " + "RNCID_1", "CellID_1", *doubles(["Latitude_1", "Longitude_1"], 9)],
               "joined"), 9)

    def one_position(s, d):
        table = main_table(s, d)
        first = table.agg(F.min(F.struct("CellID_1", "RNCID_1")).alias("k")).first()["k"]
        return st.station_position(table, first["RNCID_1"], first["CellID_1"])

    add("prj11_station_position", one_position,
        select(q.JOINED, ["DISTINCT " + sql_double("Latitude_1", "Latitude_1", 9),
                          sql_double("Longitude_1", "Longitude_1", 9)], "joined",
               "WHERE CellID_1 = (SELECT min(CellID_1) FROM joined)"), 9)
    add("smp4_repeated_split",
        lambda s, d: sampling.repeated_splits(star_reports(s, d, slots=()).select("row_id"), ["row_id"], range(10)),
        "SELECT event_id AS row_id, CAST(split AS BIGINT) AS split, "
        f"CAST({q.is_test('split', 'event_id')} AS BIGINT) AS is_test "
        "FROM events, (VALUES " + ", ".join(f"({i})" for i in range(10)) + ") v(split)")

    # mean offset per station, errors and medians
    mean = q.splits(SPLITS) + q.scored(q.OWN_MEAN)
    add("ml16_mean_offset_errors",
        lambda s, d: errors_of(s, d)[1].select("split", "row_id", *STATION, "dist"),
        select(mean, ["CAST(split AS BIGINT) AS split", "row_id", *STATION, *doubles(["dist"], 3)], "scored"))
    add("met7_distance_error",
        lambda s, d: errors_of(s, d)[1].groupBy("split").agg(
            F.avg("dist").alias("mean_error"), F.count("dist").alias("n")),
        select(mean, ["CAST(split AS BIGINT) AS split", sql_double("avg(dist)", "mean_error", 3),
                      "count(dist) AS n"], "scored", "GROUP BY split"))
    errors = q.mean_errors(SPLITS)
    add("jn13_error_table", lambda s, d: errors_of(s, d)[2],
        select(errors, ["row_id", *STATION, *doubles(["dist"], 3)], "errors"))
    add("met8_error_by_rank",
        lambda s, d: ranking.sorted_curve(errors_of(s, d)[1], ["split"], "dist")
        .groupBy("rank").agg(F.avg("dist").alias("dist"), F.count(F.lit(1)).alias("n")),
        f"WITH {mean} SELECT CAST(rank AS BIGINT) AS rank, {sql_double('avg(dist)', 'dist', 3)}, "
        "count(*) AS n FROM (SELECT dist, row_number() OVER (PARTITION BY split ORDER BY dist) - 1 "
        "AS rank FROM scored) GROUP BY rank")

    def overall(s, d):
        errs = cut(errors_of(s, d)[2].withColumn("model", F.lit("mean_offset")))
        return (
            metrics.error_range(errs, ["model"])
            .join(ranking.upper_median(errs, ["model"], "dist", "upper_median"), "model")
            .join(ranking.middle_median(errs, ["model"], "dist", "median"), "model")
        )

    add("met9_overall_median", overall,
        f"WITH {errors} SELECT 'mean_offset' AS model, {sql_double('min(dist)', 'lowest', 3)}, "
        f"{sql_double('max(dist)', 'highest', 3)}, count(*) AS n, "
        f"{sql_double('list_sort(list(dist))[count(*) // 2 + 1]', 'upper_median', 3)}, "
        f"{sql_double('median(dist)', 'median', 3)} FROM errors")
    med = errors + q.medians()
    add("met10_station_median", lambda s, d: pos.station_medians(errors_of(s, d)[2]),
        select(med, [*STATION, *doubles(["median_error"], 3)], "medians"))
    ranked = med + q.ranked_stations()

    def medians_of(s, d):
        return cut(pos.station_medians(errors_of(s, d)[2]))

    for name, pick in (("best", pos.best_stations), ("worst", pos.worst_stations)):
        add(f"top2_{name}_stations", lambda s, d, pick=pick: pick(medians_of(s, d)),
            select(ranked, [*STATION, *doubles(["median_error"], 3)], name))
    add("top5_error_curve",
        lambda s, d: ranking.sorted_curve(errors_of(s, d)[2], STATION, "dist"),
        select(errors, [*STATION, "CAST(row_number() OVER (PARTITION BY RNCID_1, CellID_1 ORDER BY dist) - 1 "
                        "AS BIGINT) AS rank", *doubles(["dist"], 3)], "errors"))
    add("jn10_rows_of_best_stations",
        lambda s, d: (lambda t: t[0].join(
            pos.best_stations(cut(pos.station_medians(t[2]))), STATION, "left_semi")
            .where("is_test = 0").select("split", "row_id", *STATION))(errors_of(s, d)),
        select(ranked, ["CAST(split AS BIGINT) AS split", "row_id", *STATION],
               "parts p", "WHERE NOT is_test AND EXISTS (SELECT 1 FROM best b WHERE "
               "b.RNCID_1 = p.RNCID_1 AND b.CellID_1 = p.CellID_1)"))

    # lending
    def lending_best(medians, rows):
        return pos.best_to_worst(medians)

    def lending_area(medians, rows):
        labels = st.distinct_stations(rows).select(*STATION, F.col("RNCID_1").alias("label"))
        return pos.similar_to_worst(medians, labels)

    def lent(s, d, choose):
        rows, _, errs = errors_of(s, d)
        donors, borrowers = choose(cut(pos.station_medians(errs)), rows)
        sums = pos.station_sums(rows.where("is_test = 0"), ["split"])
        return pos.lent_sums(sums, donors, borrowers, ["split"]).selectExpr(
            "split", *STATION, "n", *[f"sum_{o} * 1e6D as {o}" for o in pos.OFFSETS])

    def lent_errors(s, d, choose):
        rows, _, errs = errors_of(s, d)
        lending = choose(cut(pos.station_medians(errs)), rows)
        return pos.mean_offset_errors(rows, lending).select("split", "row_id", *STATION, "dist")

    for name, choose in (("best", lending_best), ("area", lending_area)):
        add(f"jn11_lent_rows_{name}", lambda s, d, choose=choose: lent(s, d, choose),
            f"WITH {ranked}{q.lent(name)} SELECT CAST(split AS BIGINT) AS split, RNCID_1, CellID_1, "
            f"count(*) AS n, {sql_double('sum(dlat) * 1e6', 'relative_latitude', 3)}, "
            f"{sql_double('sum(dlon) * 1e6', 'relative_longitude', 3)} FROM lent_{name} "
            "GROUP BY split, RNCID_1, CellID_1")
        number = 17 if name == "best" else 18
        add(f"ml{number}_lend_{name}_errors", lambda s, d, choose=choose: lent_errors(s, d, choose),
            select(ranked + q.lent_scored(name),
                   ["CAST(split AS BIGINT) AS split", "row_id", *STATION, *doubles(["dist"], 3)],
                   f"scored_{name}"))

    def concatenated(s, d):
        rows, _, errs = errors_of(s, d)
        train = rows.where("is_test = 0").select("split", *STATION, "row_id")
        best = pos.best_stations(cut(pos.station_medians(errs)))
        return train.unionByName(train.join(best, STATION, "left_semi")).groupBy("split", *STATION).agg(
            F.count(F.lit(1)).alias("n"))

    add("set1_concatenate_rows", concatenated,
        f"WITH {ranked} SELECT CAST(split AS BIGINT) AS split, RNCID_1, CellID_1, count(*) AS n FROM ("
        "SELECT split, RNCID_1, CellID_1 FROM parts WHERE NOT is_test UNION ALL "
        "SELECT split, p.RNCID_1, p.CellID_1 FROM parts p JOIN best b ON b.RNCID_1 = p.RNCID_1 AND "
        "b.CellID_1 = p.CellID_1 WHERE NOT is_test) GROUP BY split, RNCID_1, CellID_1")

    # cells: the main station's cell as a prediction of the record's cell
    def station_cell(s, d):
        rep = st.with_cells(main_table(s, d), "Latitude_m", "Longitude_m", extent=extent_of(s, d)
                            .toDF("Latitude_m", "Longitude_m"))
        grid = grid_of(extent_of(s, d), "Latitude", "Longitude")
        return rep.withColumn("prediction", grid.cell_of(F.col("Latitude_1"), F.col("Longitude_1"))).select(
            "row_id", *STATION, "Target", "prediction")

    cells = q.JOINED + (f", cells AS (SELECT row_id, RNCID_1, CellID_1, Target, "
                        f"{q.cell('Latitude_1', 'Longitude_1')} AS prediction FROM joined, grid)")
    top = (", top AS (SELECT prediction AS cell, count(*) AS p, count(*) FILTER (WHERE Target = prediction) AS h "
           "FROM cells GROUP BY prediction ORDER BY p DESC, cell LIMIT 10), "
           "truth AS (SELECT Target AS cell, count(*) AS t FROM cells GROUP BY Target), "
           "sums AS (SELECT sum(h)::DOUBLE AS h, sum(p)::DOUBLE AS p, sum(coalesce(t, 0))::DOUBLE AS t "
           "FROM top LEFT JOIN truth USING (cell))")
    add("met6_top_cell_scores",
        lambda s, d: metrics.top_cell_scores(station_cell(s, d), "Target", "prediction"),
        f"WITH {cells}{top} SELECT {sql_double('h / t', 'recall')}, {sql_double('h / p', 'precision')}, "
        f"{sql_double('CASE WHEN h = 0 THEN 0 ELSE 2 * (h / t) * (h / p) / (h / t + h / p) END', 'f')}, "
        f"(SELECT {sql_double('avg((Target = prediction)::INT)', 'a')} FROM cells) AS accuracy FROM sums", 6)
    add("top3_frequent_predictions",
        lambda s, d: metrics.top_values(station_cell(s, d), "prediction", 10),
        f"WITH {cells} SELECT prediction, count(*) AS n FROM cells GROUP BY prediction "
        "ORDER BY n DESC, prediction LIMIT 10")
    add("met1_cell_accuracy",
        lambda s, d: station_cell(s, d).agg(
            F.avg((F.col("Target") == F.col("prediction")).cast("double")).alias("accuracy")),
        f"WITH {cells} SELECT {sql_double('avg((Target = prediction)::INT)', 'accuracy')} FROM cells", 6)
    add("top4_first_two_labels",
        lambda s, d: metrics.first_of_group(station_cell(s, d), STATION, "Target", 2),
        f"WITH {cells} SELECT RNCID_1, CellID_1, Target FROM (SELECT *, row_number() OVER "
        "(PARTITION BY RNCID_1, CellID_1 ORDER BY Target) AS r FROM (SELECT DISTINCT RNCID_1, CellID_1, Target "
        "FROM cells)) WHERE r <= 2")

    # comparison of own, best-lending and area-lending medians
    def comparison(s, d):
        rows, _, errs = errors_of(s, d)
        own = cut(pos.station_medians(errs))
        out = {"own": own}
        for name, choose in (("best", lending_best), ("area", lending_area)):
            scored = pos.mean_offset_errors(rows, choose(own, rows))
            out[name] = cut(pos.station_medians(pos.error_table(scored)))
        return pos.compare_methods(out, "own")

    ctes, cols, joins = ranked, [sql_double("m.median_error", "own", 3)], ""
    for name in ("best", "area"):
        ctes += q.lent_scored(name) + q.error_rows(f"_{name}") + q.medians(f"errors_{name}", f"medians_{name}")
        joins += f" LEFT JOIN medians_{name} {name[0]} USING (RNCID_1, CellID_1)"
        cols += [sql_double(f"{name[0]}.median_error", name, 3),
                 f"CAST(coalesce({name[0]}.median_error < m.median_error, false) AS BIGINT) AS {name}_improved"]
    add("top6_method_comparison", comparison,
        f"WITH {ctes} SELECT RNCID_1, CellID_1, {', '.join(cols)}, "
        "CAST(w.CellID_1 IS NOT NULL AS BIGINT) AS was_worst FROM medians m" + joins +
        " LEFT JOIN (SELECT RNCID_1, CellID_1 FROM worst) w USING (RNCID_1, CellID_1)")

    # forests per station
    def forest(s, d, choose=None, cluster=False):
        rows, _, errs = errors_of(s, d, wide=True)
        train, test = rows.where("split = 0 and is_test = 0"), rows.where("split = 0 and is_test = 1")
        lending = None
        if choose is not None or cluster:
            med = cut(pos.station_medians(errs))
            if cluster:
                lending = pos.similar_to_worst(med, pos.cluster_stations(train, med))
            else:
                lending = choose(med, rows)
        out = pos.forest_errors(train, test, lending, trees=5, depth=4)
        return out.select("row_id", *STATION, "pred_latitude", "pred_longitude", "dist")

    r.add("ml16_station_forest", forest)
    r.add("ml17_forest_lend_best", lambda s, d: forest(s, d, lending_best))
    r.add("ml18_forest_lend_similar", lambda s, d: forest(s, d, cluster=True))
