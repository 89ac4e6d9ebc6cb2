"""Registered sampling, metric, model and sink queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from cartwave.functions.columns import drop_containing, half_even, yes_no, zero_nulls
from cartwave.functions.geo import grid_of
from cartwave.learners import extra
from cartwave.learners import models as ml
from cartwave.learners.neighbours import average, nearest, vote
from cartwave.operators import labels, metrics, sampling
from cartwave.plans import datasets as ds
from cartwave.plans import positioning as pos
from cartwave.plans import training as tr
from cartwave.registry import signal_sql as sq
from cartwave.registry import trade_sql as q
from cartwave.registry.base import Registry, rounded, sql_double, sql_whole
from cartwave.registry.purchase import light
from cartwave.registry.signal import errors_of, extent_of, table_of, training_of
from cartwave.session import cut, fresh_path
from cartwave.sources import store
from cartwave.sources.trade import star_trade
from cartwave.sources.windows import SCORE, TEST, TRAIN, Window

M, L = TRAIN.feature_months, TRAIN.label_month
PAIR = ["user_id", "brand_id"]
MONTHLY = ("frequency", "days", "amts")


def labelled_pairs(t: DataFrame) -> DataFrame:
    """User x brand pairs of the window with their label, stored: sampling reads it often."""
    pairs = light(t).rolled(*PAIR).select(*PAIR)
    return cut(ds.attach_label(pairs, labels.bought(t, L, PAIR), PAIR))


def monthly_users(t: DataFrame, window: Window, spend: bool = False) -> DataFrame:
    """Users with their monthly columns as f1..f9 and the label of the window."""
    m = window.feature_months
    cols = [f"u_count_{x}_{a} as f{i}" for i, (a, x) in
            enumerate(((a, x) for a in MONTHLY for x in m), 1)]
    users = light(t, m).activity("user_id").selectExpr("user_id", *cols)
    label = labels.spent(t, window.label_month) if spend else labels.bought(
        t, window.label_month, ["user_id"])
    return ds.attach_label(users, label, ["user_id"])


def monthly_sql(window: Window, spend: bool = False) -> str:
    m = window.feature_months
    cols = ", ".join(f"u_count_{x}_{a} AS f{i}" for i, (a, x) in
                     enumerate(((a, x) for a in MONTHLY for x in m), 1))
    label = q.spend_label(window.label_month) if spend else q.label(("user_id",), window.label_month)
    both = q.activity(("user_id",), m).joined(label)
    return f"SELECT user_id, {cols}, target::DOUBLE AS target FROM ({both.body}) b"


def ruled(t: DataFrame) -> DataFrame:
    """A fixed rule as prediction: at least three rows in the last month."""
    return monthly_users(t, TRAIN).withColumn("prediction", (F.col("f3") >= 3).cast("int"))


RULED = f"SELECT *, CASE WHEN f3 >= 3 THEN 1 ELSE 0 END AS prediction FROM ({monthly_sql(TRAIN)}) u"


def spend_rule(t: DataFrame) -> DataFrame:
    """A fixed rule as amount: the mean of the window's months."""
    return monthly_users(t, TRAIN, spend=True).withColumn(
        "prediction", (F.col("f7") + F.col("f8") + F.col("f9")) / 3)


SPEND_RULE = f"SELECT *, (f7 + f8 + f9) / 3 AS prediction FROM ({monthly_sql(TRAIN, True)}) u"


def buy_vectors(t: DataFrame, window: Window) -> DataFrame:
    keys = ["user_id"]
    return cut(ml.to_vectors(ds.buy_dataset(t, window), keys))


def hashed(keys: str, seed: int) -> str:
    return f"substr(md5('{seed}|' || {keys}), 1, 8)"


def register(r: Registry) -> None:
    def on_trade(build, places=6):
        return lambda spark, sf: rounded(build(star_trade(spark, sf)), places)

    def add(name, build, sql=None, places=6):
        r.add(name, on_trade(build, places), None if sql is None else f"WITH {q.TRADE}{sql}")

    # -- sampling ---------------------------------------------------------
    pair_label = (
        f", pairs AS (SELECT p.user_id, p.brand_id, coalesce(l.target, 0) AS target FROM "
        f"(SELECT DISTINCT user_id, brand_id FROM trade WHERE month IN ({q.month_list(M)})) p "
        f"LEFT JOIN ({q.label(PAIR, L).body}) l USING (user_id, brand_id)), hashed AS (SELECT *, "
        f"""{hashed("user_id || '|' || brand_id", 0)} AS h FROM pairs)"""
    )
    order = "row_number() OVER (ORDER BY h, user_id, brand_id)"
    row = f"user_id, brand_id, {sql_whole('target', 'target')}"
    for number, keep in ((1, 1), (2, 0)):
        add(f"smp{number}_undersample_{'negatives' if keep else 'positives'}",
            lambda t, keep=keep: sampling.balanced_down(labelled_pairs(t), PAIR, keep),
            f"{pair_label} SELECT {row} FROM pairs WHERE target = {keep} UNION ALL SELECT {row} FROM "
            f"(SELECT *, {order} AS r FROM hashed WHERE target = {1 - keep}) "
            f"WHERE r <= (SELECT count(*) FROM pairs WHERE target = {keep})")
    add("smp3_oversample_minority",
        lambda t: sampling.balanced_up(labelled_pairs(t), PAIR),
        f"{pair_label}, sizes AS (SELECT count(*) FILTER (WHERE target = 0) AS big, "
        "count(*) FILTER (WHERE target = 1) AS small FROM pairs) "
        f"SELECT {row} FROM pairs WHERE target = 0 UNION ALL SELECT {row} FROM "
        f"(SELECT *, {order} AS r FROM hashed WHERE target = 1), sizes, "
        "generate_series(1, big // small + 1) g(i) WHERE i <= big // small OR r <= big % small")
    add("smp5_stratified_folds",
        lambda t: sampling.with_fold(labelled_pairs(t), PAIR, 4, seed=0)
        .groupBy("fold", "target").agg(F.count(F.lit(1)).alias("n")),
        f"{pair_label} SELECT CAST(('0x' || h)::BIGINT * 4 // 4294967296 AS BIGINT) AS fold, "
        "CAST(target AS BIGINT) AS target, count(*) AS n FROM hashed GROUP BY ALL")
    add("smp5_exact_stratified_folds",
        lambda t: sampling.with_exact_fold(labelled_pairs(t), PAIR, 4, seed=0),
        f"{pair_label} SELECT user_id, brand_id, CAST(target AS BIGINT) AS target, CAST((row_number() OVER (PARTITION BY target "
        "ORDER BY h, user_id, brand_id) - 1) % 4 AS BIGINT) AS fold FROM hashed")
    add("smp6_folds",
        lambda t: sampling.with_fold(monthly_users(t, TRAIN).select("user_id"), ["user_id"], 3),
        f" SELECT user_id, CAST(('0x' || {hashed('user_id', 78)})::BIGINT * 3 // 4294967296 AS BIGINT) AS fold "
        f"FROM ({monthly_sql(TRAIN)}) u")

    # -- metrics on fixed predictions -------------------------------------
    counts = (
        "count(*)::DOUBLE AS n, count(*) FILTER (WHERE target = 1 AND prediction = 1)::DOUBLE AS tp, "
        "count(*) FILTER (WHERE target = 1 AND prediction = 0)::DOUBLE AS fn, "
        "count(*) FILTER (WHERE target = 0 AND prediction = 0)::DOUBLE AS tn, "
        "count(*) FILTER (WHERE target = 0 AND prediction = 1)::DOUBLE AS fp"
    )
    auc = "(tp / (tp + fn) + tn / (tn + fp)) / 2"
    add("met2_hard_label_auc", lambda t: metrics.class_scores(ruled(t)),
        f" SELECT CAST(n AS BIGINT) AS n, {sql_double('(tp + tn) / n', 'accuracy')}, "
        f"{sql_double('tp / (tp + fn)', 'recall')}, {sql_double(auc, 'auc')} "
        f"FROM (SELECT {counts} FROM ({RULED}) p)")
    fold = f"('0x' || {hashed('user_id', 78)})::BIGINT * 3 // 4294967296"
    add("met3_fold_scores",
        lambda t: metrics.fold_scores(
            cut(sampling.with_fold(ruled(t), ["user_id"], 3).withColumn("score", F.col("f3").cast("double"))), score="score"),
        f", r AS (SELECT *, {fold} AS fold FROM ({RULED}) p), f AS (SELECT fold, {counts} FROM r GROUP BY 1), "
        "k AS (SELECT fold, target, rank() OVER (PARTITION BY fold ORDER BY f3) "
        "+ (count(*) OVER (PARTITION BY fold, f3) - 1) / 2.0::DOUBLE AS place FROM r), "
        "c AS (SELECT fold, sum(place) FILTER (WHERE target = 1) AS places FROM k GROUP BY 1), "
        f"s AS (SELECT tp / (tp + fn) AS recall, (tp + tn) / n AS accuracy, {auc} AS auc, "
        "(places - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (tn + fp)) AS rank_auc FROM f JOIN c USING (fold)) SELECT "
        + ", ".join(f"{sql_double(f'avg({x})', f'{x}_mean')}, {sql_double(f'stddev_pop({x})', f'{x}_std')}"
                    for x in ("recall", "accuracy", "auc", "rank_auc")) + " FROM s")
    for name, by_truth in (("met4_prediction_distribution", False), ("met4_distribution_by_truth", True)):
        add(name, lambda t, by_truth=by_truth: metrics.prediction_distribution(
            ruled(t), wrong_by_truth=by_truth),
            f" SELECT (target = prediction)::BIGINT AS correct, "
            f"CAST({'target' if by_truth else 'prediction'} AS BIGINT) AS label, count(*) AS n "
            f"FROM ({RULED}) p GROUP BY ALL")
    # errors as exact decimals: sums do not depend on the order of rows
    error = "CAST(CAST(target - prediction AS DECIMAL(18,6)) AS DECIMAL(38,6))"
    add("met5_regression_errors", lambda t: metrics.regression_scores(spend_rule(t), exact=True),
        f" SELECT {sql_double('1 - var_pop(target - prediction) / var_pop(target)', 'evs', 4)}, "
        f"{sql_double(f'CAST(sum(abs({error})) AS DOUBLE) / count(*)', 'mae', 4)}, "
        f"{sql_double(f'CAST(sum({error} * {error}) AS DOUBLE) / count(*)', 'mse', 4)} "
        f"FROM ({SPEND_RULE}) p", 4)

    def rules(t):
        users = cut(monthly_users(t, TRAIN))
        out = None
        for k in range(1, 6):
            part = metrics.class_scores(
                users.withColumn("prediction", (F.col("f3") >= k).cast("int"))
                .withColumn("Model", F.lit(f"at_least_{k}")), ["Model"])
            out = part if out is None else out.unionByName(part)
        return out.select("Model", "auc", "accuracy").orderBy(F.col("auc").desc(), "Model")

    add("top1_rule_leaderboard", rules,
        f", u AS ({monthly_sql(TRAIN)}), p AS (SELECT 'at_least_' || k AS Model, target, "
        "(f3 >= k)::INT AS prediction FROM u, generate_series(1, 5) g(k)) "
        f"SELECT Model, {sql_double(auc, 'auc')}, {sql_double('(tp + tn) / n', 'accuracy')} "
        f"FROM (SELECT Model, {counts} FROM p GROUP BY Model)")
    add("jn12_amount_times_flag",
        lambda t: tr.two_stage(spend_rule(t), ruled(t)).select("user_id", "prediction"),
        f" SELECT s.user_id, {sql_double('s.prediction * b.prediction', 'prediction', 4)} "
        f"FROM ({SPEND_RULE}) s JOIN ({RULED}) b ON b.user_id = s.user_id", 4)
    add("prj5_feature_vectors",
        lambda t: ml.to_vectors(monthly_users(t, TRAIN), ["user_id"], features=[f"f{i}" for i in range(1, 10)])
        .select("user_id", "target", F.aggregate(
            vector_to_array("features"), F.lit(0.0), lambda a, v: a + v).alias("total")),
        f" SELECT user_id, CAST(target AS BIGINT) AS target, "
        f"{sql_double('f1 + f2 + f3 + f4 + f5 + f6 + f7 + f8 + f9', 'total')} FROM ({monthly_sql(TRAIN)}) u")

    # -- sinks ------------------------------------------------------------
    def written_csv(df, schema, header=False):
        path = fresh_path(df.sparkSession, "csv")
        store.write_csv(df, path, header)
        return df.sparkSession.read.schema(schema).csv(path, header=header)

    add("snk3_class_file",
        lambda t: written_csv(tr.class_output(ruled(t), ["user_id"]), "user_id long, target string"),
        f" SELECT user_id, CASE WHEN prediction = 1 THEN 'Yes' ELSE 'No' END AS target FROM ({RULED}) p")
    add("snk4_amount_file",
        lambda t: written_csv(tr.amount_output(spend_rule(t)), "user_id long, label double"),
        f" SELECT user_id, {sql_double('round_even(prediction, 2)', 'label')} FROM ({SPEND_RULE}) p")
    add("snk5_pair_file",
        lambda t: written_csv(tr.pair_output(spend_rule(t)), "target double, label double", True),
        f" SELECT {sql_double('round_even(target, 2)', 'target')}, "
        f"{sql_double('round_even(prediction, 2)', 'label')} FROM ({SPEND_RULE}) p")
    add("fn2_rounding",
        lambda t: spend_rule(t).select(
            "user_id", half_even(F.col("prediction")).alias("even"),
            F.ceil(F.col("f1") * 0.2).alias("up"), F.floor(F.col("f7") / 20).alias("down")),
        f" SELECT user_id, {sql_double('round_even(prediction, 2)', 'even')}, "
        f"{sql_whole('ceil(f1 * 0.2::DOUBLE)', 'up')}, {sql_whole('floor(f7 / 20)', 'down')} FROM ({SPEND_RULE}) p")
    add("fn3_flag_text",
        lambda t: ruled(t).select("user_id", yes_no(F.col("prediction")).alias("answer")),
        f" SELECT user_id, CASE WHEN prediction = 1 THEN 'Yes' ELSE 'No' END AS answer FROM ({RULED}) p")

    def stored_dataset(t):
        path = fresh_path(t.sparkSession, "train")
        ds.write_window(t, TRAIN, path, ("user",))
        return ds.read_dataset(t.sparkSession, path, "user", TRAIN)

    r.add("snk1_src3_labelled_table", on_trade(stored_dataset), q.buy(M, L).final(q.TRADE))

    def stored_families(t):
        path = fresh_path(t.sparkSession, "families")
        p = light(t)
        store.write_families({("item_id",): p.activity("item_id")}, path)
        return store.read_family(t.sparkSession, path, ("item_id",))

    r.add("snk2_feature_family", on_trade(stored_families), q.activity(("item_id",), M).final(q.TRADE))

    def built_once(t):
        path = fresh_path(t.sparkSession, "table")
        build = lambda: light(t).penetration("brand_id")
        store.read_or_build(t.sparkSession, path, build)
        return store.read_or_build(t.sparkSession, path, build)

    r.add("src4_read_or_build", on_trade(built_once), q.penetration("brand_id", M).final(q.TRADE))

    def stored_board(t):
        path = fresh_path(t.sparkSession, "board")
        store.write_board(rules(t), path)
        return t.sparkSession.read.parquet(path)

    add("snk6_leaderboard", stored_board, r.sql["top1_rule_leaderboard"].removeprefix(f"WITH {q.TRADE}"))

    def stored_errors(spark, sf):
        path = fresh_path(spark, "errors")
        store.write_errors(errors_of(spark, sf)[2], path)
        return rounded(spark.read.parquet(path), 3)

    r.add("snk7_error_table", stored_errors, r.sql["jn13_error_table"])

    def stored_table(spark, sf):
        kept = drop_containing(training_of(spark, sf), pos.NOT_FEATURES)
        return rounded(store.read_or_build(spark, fresh_path(spark, "mr"), lambda: kept), 9)

    r.add("snk8_training_table", stored_table, r.sql["prj3_drop_by_fragment"])

    # -- models that SQL can check ----------------------------------------
    def naive_bayes(t):
        fs = [f"f{i}" for i in range(1, 10)]
        train = ml.to_vectors(monthly_users(t, TRAIN), ["user_id"], features=fs)
        test = ml.to_vectors(monthly_users(t, TEST), ["user_id"], features=fs)
        model = dict(ml.classifiers())["GaussianNB"].fit(train)
        return model.transform(test).select("user_id", F.col("prediction").cast("long").alias("prediction"))

    stats = ", ".join(f"avg(f{i}) AS m{i}, var_pop(f{i}) + (SELECT e FROM eps) AS v{i}" for i in range(1, 10))
    score = " + ".join(f"ln(2 * pi() * v{i}) + power(f{i} - m{i}, 2) / v{i}" for i in range(1, 10))
    top_var = ", ".join(f"var_pop(f{i})" for i in range(1, 10))
    add("ml2_gaussian_nb", naive_bayes,
        f", a AS ({monthly_sql(TRAIN)}), b AS ({monthly_sql(TEST)}), "
        f"eps AS (SELECT 1e-9 * greatest({top_var}) AS e FROM a), "
        f"s AS (SELECT target AS c, count(*) AS n, {stats} FROM a GROUP BY target), "
        f"z AS (SELECT user_id, c, ln(n::DOUBLE) - 0.5 * ({score}) AS p FROM b, s) "
        "SELECT user_id, CAST(arg_max(c, p) AS BIGINT) AS prediction FROM z GROUP BY user_id")

    every = [f"f{i}" for i in range(1, 10)]
    away = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in every)

    def near_sql(k, spend):
        return (f", a AS ({monthly_sql(TRAIN, spend)}), b AS ({monthly_sql(TEST, spend)}), "
                f"n AS (SELECT b.user_id, a.target, row_number() OVER (PARTITION BY b.user_id ORDER BY {away}, "
                f"a.user_id) AS r FROM a, b), k AS (SELECT * FROM n WHERE r <= {k}) ")

    def near(t, k, spend):
        return nearest(monthly_users(t, TRAIN, spend), monthly_users(t, TEST, spend), every, k,
                       "user_id", "user_id")

    add("ml3_nearest_neighbours", lambda t: vote(near(t, 3, False), "user_id").select(
        "user_id", F.col("prediction").cast("long").alias("prediction")),
        near_sql(3, False) + "SELECT user_id, CAST(sum(target) >= 2 AS BIGINT) AS prediction FROM k GROUP BY user_id")
    add("ml10_nearest_neighbours_spend", lambda t: average(near(t, 5, True), "user_id"),
        near_sql(5, True) + f"SELECT user_id, {sql_double('avg(target)', 'prediction', 3)} FROM k GROUP BY user_id", 3)

    def one_feature(t):
        train = ml.to_vectors(monthly_users(t, TRAIN, True), ["user_id"], features=["f9"])
        model = ml.linear().fit(train)
        test = ml.to_vectors(monthly_users(t, TEST, True), ["user_id"], features=["f9"])
        return model.transform(test).select("user_id", "prediction")

    add("ml11_linear_one_feature", one_feature,
        f", a AS ({monthly_sql(TRAIN, True)}), b AS ({monthly_sql(TEST, True)}) SELECT user_id, "
        f"{sql_double('f9 * (SELECT regr_slope(target, f9) FROM a) + (SELECT regr_intercept(target, f9) FROM a)', 'prediction', 2)} FROM b", 2)

    def ridge_one_feature(t):
        train = cut(ml.to_vectors(monthly_users(t, TRAIN, True), ["user_id"], features=["f9"]))
        facts = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("target").alias("spread")).first()
        model = ml.linear("ridge", 500.0, facts["n"], facts["spread"]).fit(train)
        test = ml.to_vectors(monthly_users(t, TEST, True), ["user_id"], features=["f9"])
        return model.transform(test).select("user_id", "prediction")

    add("ml11_ridge", ridge_one_feature,
        f", a AS ({monthly_sql(TRAIN, True)}), b AS ({monthly_sql(TEST, True)}), s AS (SELECT "
        "regr_sxy(target, f9) / (regr_sxx(target, f9) + 500) AS slope, avg(target) AS my, avg(f9) AS mx FROM a) SELECT user_id, "
        f"{sql_double('f9 * slope + my - mx * slope', 'prediction', 2)} FROM b, s", 2)

    # -- models without a SQL counterpart ---------------------------------
    def classify(name, task="user_brand"):
        def run(t):
            train, test = buy_vectors(t, TRAIN), buy_vectors(t, TEST)
            model = dict(ml.classifiers(task))[name].fit(train)
            return model.transform(test).select("user_id", "target", "prediction")
        return run

    add("ml4_adaboost", classify("AdaBoostClassifier"))
    add("ml5_random_forest", classify("RandomForestClassifier", "user"))
    add("ml6_bagging", classify("BaggingClassifier"))
    add("ml7_decision_tree", classify("DecisionTreeClassifier", "user"))
    add("ml9_gradient_boosting", classify("GradientBoostingClassifier"))

    def logistic(t):
        train, test = buy_vectors(t, TRAIN), buy_vectors(t, TEST)
        return ml.l1_logistic(0.3, train.count()).fit(train).transform(test).select(
            "user_id", "target", "prediction")

    add("ml8_l1_logistic", logistic)

    # the three selections: pairs balanced up at 0.7 of the mean, pairs as they are at the mean, buyers at the median
    def selected(build, keys, threshold, balance=False):
        def run(t):
            table = cut(build(t, TRAIN))
            names = [c for c in table.columns if c not in (*keys, "target")]
            balanced = cut(sampling.balanced_up(table, keys)) if balance else table
            return table.select(*keys, "target", *ml.important_features(balanced, names, threshold))
        return run

    pair_table = lambda attribute: lambda t, w: ds.user_pair_dataset(t, w, attribute)
    add("ml1_feature_selection", selected(ds.buy_dataset, ["user_id"], "median"))
    add("ml1_brand_selection", selected(pair_table("brand"), ["user_id", "brand_id"], "0.7*mean", True))
    add("ml1_category_selection", selected(pair_table("cat"), ["user_id", "cat_id"], "mean"))

    # every tree's first cut
    def first_cuts(t):
        table = cut(monthly_users(t, TRAIN))
        trees = extra.grown(extra.stored_rows(table, every), len(every), 2, depth=1)
        return t.sparkSession.createDataFrame(
            [(i, every[tree[1].feature], tree[1].at, tree[1].fall) for i, tree in enumerate(trees) if tree], "tree long, feature string, cut double, fall double")

    def drawn(tail):
        return f"('0x' || substr(md5('6|' || tree || '|1|' || (f - 1) || '{tail}'), 1, 8))::BIGINT / 4294967296::DOUBLE"

    def impure(n, ones):
        return f"({n} - (({ones}) * ({ones}) + ({n} - {ones}) * ({n} - {ones}))::DOUBLE / nullif({n}, 0))"

    add("ml1_first_cuts", first_cuts,
        f", a AS ({monthly_sql(TRAIN)}), v AS (SELECT target, unnest([{', '.join(f'{c}::DOUBLE' for c in every)}]) AS x, unnest(range(1, 10)) AS f FROM a), "
        "e AS (SELECT f, min(x) AS lo, max(x) AS hi FROM v GROUP BY f HAVING min(x) < max(x)), "
        f"c AS (SELECT tree, f, lo + {drawn('')} * (hi - lo) AS cut, row_number() OVER (PARTITION BY tree ORDER BY {drawn('|pick')}, f) AS place "
        "FROM e, range(10) r(tree) QUALIFY place <= 3), "
        "n AS (SELECT tree, f, cut, place, count(*) AS n, sum(target) AS ones, count(*) FILTER (WHERE x <= cut) AS nl, "
        "coalesce(sum(target) FILTER (WHERE x <= cut), 0) AS lones FROM c JOIN v USING (f) GROUP BY ALL), "
        f"g AS (SELECT *, ({impure('n', 'ones')} - coalesce({impure('nl', 'lones')}, 0) - coalesce({impure('(n - nl)', '(ones - lones)')}, 0)) / n AS fall FROM n), "
        "k AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY fall DESC, place) AS r FROM g) "
        f"SELECT CAST(tree AS BIGINT) AS tree, 'f' || f AS feature, {sql_double('cut', 'cut')}, {sql_double('fall', 'fall')} FROM k WHERE r = 1")

    def spend_vectors(t, window):
        return cut(ml.to_vectors(ds.spend_dataset(t, window), ["user_id"]))

    def spend_board(t, stages=1):
        train, test = spend_vectors(t, TRAIN), spend_vectors(t, TEST)
        buys = None
        if stages == 2:
            nb = dict(ml.classifiers())["GaussianNB"].fit(buy_vectors(t, TRAIN))
            buys = nb.transform(buy_vectors(t, TEST)).select("user_id", "prediction")
        board, _, _ = tr.rank_regressors(ml.regressors(), train, test, buys, parallelism=4)
        return board.drop("Time")

    add("ml10_spend_leaderboard", spend_board)
    add("ml12_two_stage_spend", lambda t: spend_board(t, 2))

    def board(t):
        train, test = buy_vectors(t, TRAIN), buy_vectors(t, TEST)
        out, _ = tr.rank_classifiers(ml.classifiers("user"), train, test, ["user_id"], parallelism=4)
        return out.drop("Time")

    add("ml13_leaderboard", board)
    def searched(t):
        train = buy_vectors(t, TRAIN)
        n = train.count() * 3 / 4  # rows that a fold's model is trained on
        return tr.grid_search(
            ml.l1_logistic(0.9, n), {"regParam": [1.0 / (c * n) for c in tr.GRIDS["logistic_c_balanced"]]}, train, ["user_id"])

    add("ml14_grid_search", searched)

    def score_unlabelled(t):
        model = dict(ml.classifiers("user"))["GaussianNB"].fit(buy_vectors(t, TRAIN))
        scored = model.transform(buy_vectors(t, SCORE))
        return written_csv(tr.class_output(scored, ["user_id"]), "user_id long, target string")

    add("ml19_score_window", score_unlabelled)

    def cells(spark, sf):
        table = cut(zero_nulls(table_of(spark, sf), keep=("row_id",)), "row_id")
        grid = grid_of(extent_of(spark, sf), "Latitude", "Longitude")
        board, _ = pos.rank_cell_models(pos.cell_models(), table, grid)
        return rounded(board.drop("Time"))

    r.add("ml15_grid_cell_models", cells)

    # every split's first stump: bins, sums per cell and impurity written out
    slots = range(1, 8)
    stump_features = ["Num_connected", *[f"{c}_{i}" for c in ("RSSI", "Longitude", "Latitude") for i in slots]]

    def stumps(spark, sf):
        table = cut(zero_nulls(table_of(spark, sf), keep=("row_id",)), "row_id")
        return rounded(pos.first_stumps(table, stump_features))

    listed = ", ".join(f"coalesce({c}, 0)::DOUBLE" for c in stump_features)
    r.add("ml15_first_cell_stumps", stumps,
          f"WITH {sq.JOINED}, v AS (SELECT row_id, Target, unnest([{listed}]) AS x, unnest(range({len(stump_features)})) AS f FROM joined), "
          "e AS (SELECT f, min(x) AS lo, max(x) AS hi FROM v GROUP BY f), "
          "b AS (SELECT row_id, Target, f, CASE WHEN hi > lo THEN CAST(least(31, greatest(0, floor((x - lo) / (hi - lo) * 32))) AS BIGINT) "
          "ELSE 0 END AS bin FROM v JOIN e USING (f)), "
          f"h AS (SELECT split, f, bin, Target, count(*) AS n FROM b, range(10) s(split) WHERE NOT {sq.is_test('split', 'row_id')} GROUP BY ALL), "
          "t AS (SELECT split, f, Target, sum(n) AS total FROM h GROUP BY ALL), "
          "l AS (SELECT t.split, t.f, cut, t.Target, t.total, coalesce(sum(n) FILTER (WHERE bin <= cut), 0) AS n_left "
          "FROM t JOIN h USING (split, f, Target), range(32) c(cut) GROUP BY ALL), "
          "g AS (SELECT split, f, cut, sum(n_left * n_left)::DOUBLE / sum(n_left)::DOUBLE "
          "+ sum((total - n_left) * (total - n_left))::DOUBLE / sum(total - n_left)::DOUBLE AS gain, "
          "max_by(Target, [n_left, -Target]) AS left_cell, max_by(Target, [total - n_left, -Target]) AS right_cell, "
          "1 - (max(n_left) + max(total - n_left))::DOUBLE / sum(total)::DOUBLE AS error "
          "FROM l GROUP BY ALL HAVING sum(n_left) > 0 AND sum(total - n_left) > 0), "
          "k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY gain DESC, f, cut) AS r FROM g) "
          f"SELECT split, ({stump_features!r})[f + 1] AS feature, cut AS bin, left_cell, right_cell, {sql_double('error', 'error')} FROM k WHERE r = 1")
