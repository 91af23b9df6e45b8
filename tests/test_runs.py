"""Configuration, holdings, sinks, cached parameters, and whole runs on made prices."""

import datetime as dt
import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import portfolio
from tessera.sources import prices, snapshots

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def market(spark):
    """Eight tickers in two groups, 160 days."""
    made = np.random.default_rng(0)
    common = made.normal(0.0005, 0.01, (2, 160))
    rows = []
    for i in range(8):
        p = 50 * np.exp(np.cumsum(common[i // 4] + made.normal(0.0002 * i, 0.004, 160)))
        rows += [(f"T{i}", DAY + dt.timedelta(d), float(v)) for d, v in enumerate(p)]
    return spark.createDataFrame(rows, "ticker string, date date, adj_close double").withColumn("close", F.col("adj_close"))


def names(df):
    return {r["ticker"] for r in df.select("ticker").collect()}


def test_configuration_file(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(f"data_dir: {tmp_path}/data\ninput_files_dir: {tmp_path}/lists\ninput_files:\n  - a.csv\nmodels:\n  1.5:\n    - nested_clustering\nportfolio_max_size: 7\ntest_mode: true\nuse_reversion: true\nreversion_type: z\n")
    config = portfolio.Config.from_yaml(str(path))
    assert config.max_size == 7 and config.models == ((1.5, ("nested_clustering",)),) and config.visible_pct == 0.1 and config.reversion_type == "z"
    assert config.watchlists == (f"{tmp_path}/lists/a.csv",) and os.path.isdir(f"{tmp_path}/data") and os.path.isdir(f"{tmp_path}/lists")
    path.write_text("data_dir: x\n")
    with pytest.raises(ValueError, match="input_files"):
        portfolio.Config.from_yaml(str(path))


def test_chosen_symbols(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# comment\naapl\nMSFT\n\n")
    config = portfolio.Config(watchlists=(f"{tmp_path}/a.csv",))
    assert names(portfolio.chosen(spark, config)) == {"AAPL", "MSFT"} and names(portfolio.chosen(spark, config, ["X", "X"])) == {"X"}
    with pytest.raises(ValueError):
        portfolio.chosen(spark, config, ["X", 3])


def test_holdings_match(spark):
    table = lambda *t: spark.createDataFrame([(x,) for x in t], "ticker string")
    assert portfolio.holdings_match(table("A", "B"), table("B", "A", "A"))
    assert not portfolio.holdings_match(table("A"), table("A", "B")) and not portfolio.holdings_match(table("A", "B"), table("A"))
    assert portfolio.holdings_match(table(), table()) and not portfolio.holdings_match(table(), table("A"))


def test_weights_by_name(spark):
    table = lambda *a: {(r["ticker"], r["weight"]) for r in prices.weights_table(spark, *a).collect()}
    assert table({"A": 0.25, "B": 0.75}) == table([0.25, 0.75], ["A", "B"]) == {("A", 0.25), ("B", 0.75)}
    for bad in (([0.5], ["A", "B"]), ([0.5, 0.5], ["A", "A"]), ([0.5], [""]), ([0.5], [3]), ({"A": 1.0}, ["B"])):
        with pytest.raises(ValueError):
            table(*bad)


def test_histories_are_converted_and_tables_exported(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "XYZ.csv").write_text("When,Close\n2020-01-02,1.5\n2020-01-03,2.5\n")
    prices.convert_csv(spark, f"{tmp_path}/in", f"{tmp_path}/store")
    rows = prices.read_store(spark, f"{tmp_path}/store")
    assert {(r["ticker"], r["close"]) for r in rows.collect()} == {("XYZ", 1.5), ("XYZ", 2.5)}
    prices.export({"plain": rows.select("ticker", "close"), "nested": rows.groupBy("ticker").agg(F.sort_array(F.collect_list("close")).alias("x"))}, f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/plain").count() == 2 and spark.read.json(f"{tmp_path}/out/nested").first()["x"] == [1.5, 2.5]


def test_sessions_before_between_and_behind(spark):
    days = spark.createDataFrame([(dt.date(2020, 1, d),) for d in (1, 3, 4, 7, 9, 31)], "date date")
    sessions = spark.createDataFrame([(dt.date(2020, 1, d), k) for d, k in ((3, True), (4, False), (7, True), (8, False), (9, True), (10, False))], "date date, is_session boolean")
    got = lambda way: {r["date"].day: r["session"] and r["session"].day for r in prices.snap(days, sessions, way).collect()}
    assert got("forward") == {1: 3, 3: 3, 4: 7, 7: 7, 9: 9, 31: None}
    assert got("backward") == {1: None, 3: 3, 4: 3, 7: 7, 9: 9, 31: 9}


def test_report_of_a_run_is_that_of_its_weights(market):
    out = portfolio.run(market, None, portfolio.Config(benchmark="T0", min_weight=0.0))
    assert set(out) == {"weights", "report", "contributions", "boxes", "cumulative"}
    held = {r["ticker"]: r["weight"] for r in out["weights"].collect()}
    assert sum(held.values()) == pytest.approx(1) and min(held.values()) >= 0
    table = market.toPandas().pivot(index="date", columns="ticker", values="adj_close")
    logs = np.log(table).diff().dropna()
    own = (logs[list(held)] * np.array(list(held.values()))).sum(axis=1)
    line = {r["date"]: r["cum"] for r in out["cumulative"].where("ticker = 'SIM_PORT'").collect()}
    assert [line[d] for d in own.index] == pytest.approx(np.cumprod(1 + own).tolist())
    ahead = out["cumulative"].where("ticker <> 'SIM_PORT'").orderBy(F.desc("date"), "ticker").first()
    assert ahead["ahead"] == pytest.approx(ahead["cum"] - line[ahead["date"]])
    assert {r["ticker"] for r in out["contributions"].collect()} == set(held) == {r["ticker"] for r in out["boxes"].collect()}


def test_iteration_narrows_until_few_or_the_same(market, monkeypatch):
    calls = []

    def run(rows, market, config):
        left = sorted(names(rows))
        calls.append((left, config.use_decorrelation))
        return {"weights": rows.select("ticker").distinct().where(F.col("ticker").isin(left[: max(5, len(left) - 2)])).withColumn("weight", F.lit(1.0))}

    monkeypatch.setattr(portfolio, "run", run)
    portfolio.iterate(market, portfolio.Config(max_size=3, use_decorrelation=True), 9)
    assert [len(left) for left, _ in calls] == [8, 6, 5] and [filtered for _, filtered in calls] == [True, False, False]
    calls.clear()
    portfolio.iterate(market, portfolio.Config(max_size=6), 9)
    assert [len(left) for left, _ in calls] == [8]


def test_parameters_are_studied_once(spark, market, tmp_path, monkeypatch):
    from tessera.operators import windows

    returns = windows.simple_returns(market).where("ret is not null")
    labels = spark.createDataFrame([(f"T{i}", str(i // 4)) for i in range(8)], "ticker string, cluster string")
    weekly = windows.weekly_last(returns)
    asked = []
    plain = portfolio.studied

    def studied(whole, weekly, rest, objective):
        asked.append(names(rest))
        return plain(whole, weekly, rest, objective)

    monkeypatch.setattr(portfolio, "studied", studied)
    monkeypatch.setattr(portfolio, "DAILY", [5])
    monkeypatch.setattr(portfolio, "WEEKLY", [5])
    path = f"{tmp_path}/parameters"
    few = labels.where("ticker in ('T0', 'T1')")
    first = {tuple(r) for r in portfolio.known_parameters(returns, weekly, few, "sharpe", path).collect()}
    again = {tuple(r) for r in portfolio.known_parameters(returns, weekly, few, "sharpe", path).collect()}
    assert asked == [{"T0", "T1"}] and first == again and len(first) == 2
    whole = {r["ticker"]: tuple(r)[1:] for r in portfolio.known_parameters(returns, weekly, labels, "sharpe", path).collect()}
    assert asked[1:] == [{"T4", "T5", "T6", "T7"}]  # the others have a neighbour in the cache
    assert {whole[t] for t in ("T0", "T1", "T2", "T3")} == {t[1:] for t in first}
    stored = snapshots.read(spark, path)
    assert stored.count() == 8 and not list(itertools.filterfalse(lambda r: r["objective"] == "sharpe", stored.collect()))


def test_tickers_are_spelled_in_plain_letters(spark):
    import string
    import unicodedata

    given = ["brk.b", " é-ñ ", "ＡＢＣ", "ﬁx", "Ⅳ", "ĳ1", "日本", "", "ẞß", "𝐙z", "Å"]
    letters = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if c in string.ascii_letters).upper()
    rows = spark.createDataFrame([(x,) for x in given], "x string").select("x", prices.clean_ticker(F.col("x")).alias("t")).collect()
    assert {r["x"]: r["t"] for r in rows} == {x: letters(x) for x in given}


def test_nested_weights_sum_to_one_before_small_ones_go(spark, market):
    from tessera.operators import windows

    returns = windows.log_returns(market)
    whole = portfolio.nested_clustering(returns, "sharpe", floor=0.0).collect()
    assert len(whole) == 8 and sum(r["weight"] for r in whole) == pytest.approx(1, abs=1e-9)
    kept = {r["ticker"] for r in portfolio.nested_clustering(returns, "sharpe").collect()}
    assert kept == {r["ticker"] for r in whole if abs(r["weight"]) >= 0.01}
    for model in ("omega", "sharpe"):
        made = portfolio.MODELS[model](returns, "", 0.4, floor=0.0).collect()
        assert sum(r["weight"] for r in made) == pytest.approx(1, abs=1e-9) and max(r["weight"] for r in made) <= 0.4 + 1e-6
