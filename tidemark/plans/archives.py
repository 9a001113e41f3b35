"""Queries of files and stored tables, and the same in SQL. The files are workbooks, archives and fixtures that tasks write from the tables, and the library's readers read them again."""

from __future__ import annotations

import csv
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import DAY, HOUR, MINUTE, day_of, floor_to
from ..operators import bars, holidays, macro, monitors, sessions
from ..sources import SCHEMAS, feeds, fixture_csv, rates_from_zip, reference_rates_wide, store, tables, ticks, unpivot_rates, vintages
from .pit import FROM_US, MACRO_OUT, ORACLE_SQL, RATES, RELEASES, RELEASES_FROM, RELEASES_TO, fixes_of, period, query


def put_file(folder: str, name: str, content: bytes) -> None:
    store_, top = feeds.open_folder(folder)
    store_.create_dir(top)
    with store_.open_output_stream(f"{top}/{name}", compression=None) as out:
        out.write(content)


@query("fixture_read", f"SELECT {MACRO_OUT} FROM vintage")
def _(spark, d):
    folder = tables.scratch(spark, "fixture")
    rows = vintages(spark, d).select("series_id", "ref_period", "known_at", "value", "vintage_seq")
    # each series has a line of comment in front of a text that would be a row
    notes = rows.select("series_id").distinct().select(F.concat(F.lit("# "), "series_id").alias("series_id"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[1:]))
    # the writer puts quotes around what begins with its own character of comments
    notes.unionByName(rows).write.option("header", True).option("comment", "~").csv(folder)
    return fixture_csv(spark, folder, "series_id string, ref_period date, known_at long, value double, vintage_seq long").withColumn("ref_period", period())


#: Series as grids: every second one by quarters, others by months; of each period three vintages, in which it and the next two are the newest.
GRID = """n AS (SELECT 'S' || chr(65 + CAST(series_id[2:] AS INT)) AS series, CAST(series_id[2:] AS INT) % 2 = 1 AS quarterly, ref_period, vintage_seq, value FROM vintage),
g AS (SELECT series, quarterly, CAST(CASE WHEN quarterly THEN date_trunc('quarter', ref_period) ELSE ref_period END AS DATE) AS p,
  CAST(CASE WHEN quarterly THEN date_trunc('quarter', ref_period) ELSE ref_period END + to_months(CAST(vintage_seq % 3 * CASE WHEN quarterly THEN 3 ELSE 1 END AS INT)) AS DATE) AS v, max(CAST(value AS DECIMAL(15, 2))) AS value FROM n GROUP BY 1, 2, 3, 4)"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    """(series, quarterly, p, v, value): p is the first day of a period, v that of the period whose end the vintage dates from."""
    n = F.expr("int(substring(series_id, 2))")
    rows = vintages(spark, d).select(F.concat(F.lit("S"), F.chr(n + 65)).alias("series"), (n % 2 == 1).alias("quarterly"), "ref_period", "vintage_seq", F.col("value").cast("decimal(15,2)").alias("value"))
    rows = rows.withColumn("p", F.when(F.col("quarterly"), F.trunc("ref_period", "quarter")).otherwise(F.col("ref_period")))
    return rows.withColumn("v", F.add_months("p", F.expr("int(vintage_seq % 3) * if(quarterly, 3, 1)"))).groupBy("series", "quarterly", "p", "v").agg(F.max("value").alias("value"))


def workbook(frame: pd.DataFrame) -> bytes:
    """A workbook of one sheet from (row, col, text, number): texts are shared or, in every second row, inline strings."""
    shared = {t: k for k, t in enumerate(sorted(set(frame.text[~frame.number])))}

    def cell(row: int, col: int, text: str, number: bool) -> str:
        letters = ""
        while col:
            col, rest = divmod(col - 1, 26)
            letters = chr(65 + rest) + letters
        if number:
            return f'<c r="{letters}{row}"><v>{text}</v></c>'
        return f'<c r="{letters}{row}" t="inlineStr"><is><t>{text}</t></is></c>' if row % 2 else f'<c r="{letters}{row}" t="s"><v>{shared[text]}</v></c>'

    lines = (f'<row r="{row}">{"".join(cell(*c) for c in cells.itertuples(index=False, name=None))}</row>' for row, cells in frame.sort_values(["row", "col"])[["row", "col", "text", "number"]].groupby("row"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/sharedStrings.xml", '<sst xmlns="urn:x">' + "".join(f"<si><t>{t}</t></si>" for t in shared) + "</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="urn:x"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()


def archived(spark: SparkSession, d: str) -> str:
    """A folder with a workbook for each series' grid. A workbook is one task's work, as its sheet can't be cut."""
    folder = tables.scratch(spark, "workbooks")

    def put(frame: pd.DataFrame) -> pd.DataFrame:
        quarterly = bool(frame.quarterly.iloc[0])
        series = frame.series.iloc[0]
        periods, heads = sorted(set(frame.p)), sorted(set(frame.v))
        row, col = {p: k + 2 for k, p in enumerate(periods)}, {v: k + 2 for k, v in enumerate(heads)}
        quarter = lambda t: f"Q{(t.month + 2) // 3}"
        cells = [(1, col[v], f"{series}{v.year % 100:02d}{quarter(v) if quarterly else f'M{v.month}'}", False) for v in heads]
        cells += [(row[p], 1, f"{p.year}:{quarter(p) if quarterly else f'{p.month:02d}'}", False) for p in periods]
        cells += [(row[p], col[v], "#N/A" if pd.isna(x) else str(x), not pd.isna(x)) for p, v, x in zip(frame.p, frame.v, frame.value, strict=True)]
        put_file(folder, f"{series}.xlsx", workbook(pd.DataFrame(cells, columns=["row", "col", "text", "number"])))
        return pd.DataFrame({"n": [len(cells)]})

    grid(spark, d).groupBy("series").applyInPandas(put, "n long").agg(F.sum("n")).collect()
    return folder


@query("archive_cells", f"""WITH {GRID}, r AS (SELECT *, series || '.xlsx' AS name, CAST(dense_rank() OVER (PARTITION BY series ORDER BY p) + 1 AS INT) AS "row", CAST(dense_rank() OVER (PARTITION BY series ORDER BY v) + 1 AS INT) AS col FROM g)
SELECT DISTINCT name, 1 AS "row", col, series || strftime(v, '%y') || CASE WHEN quarterly THEN 'Q' || quarter(v) ELSE 'M' || month(v) END AS text FROM r
UNION ALL SELECT DISTINCT name, "row", 1, CASE WHEN quarterly THEN year(p) || ':Q' || quarter(p) ELSE strftime(p, '%Y:%m') END FROM r
UNION ALL SELECT name, "row", col, coalesce(CAST(value AS VARCHAR), '#N/A') FROM r""")
def _(spark, d):
    return feeds.workbooks(spark, archived(spark, d))


@query("archive_observations", f"WITH {GRID} SELECT series AS series_id, CAST(p AS VARCHAR) AS ref_period, epoch_us(CAST(v AS TIMESTAMP) + to_months(CASE WHEN quarterly THEN 3 ELSE 1 END)) - 1 AS known_at, CAST(value AS DOUBLE) AS value FROM g WHERE value IS NOT NULL")
def _(spark, d):
    return macro.unpivot_archive(feeds.workbooks(spark, archived(spark, d))).withColumn("ref_period", period())


@query("archive_named", f"WITH {GRID} SELECT series AS series_id, count(*) AS observations, count(DISTINCT p) AS periods, count(DISTINCT v) AS vintages FROM g WHERE value IS NOT NULL AND series IN ('SB', 'SG') GROUP BY 1")
def _(spark, d):
    rows = macro.unpivot_archive(feeds.workbooks(spark, archived(spark, d), ["SB.xlsx", "SG.xlsx"]))
    return macro.load_report(rows).select("series_id", "observations", "periods", "vintages")


@query("rates_zipped", f"WITH {RATES} SELECT substr(fix_date, 1, 7) || '.zip' AS name, fix_date, currency, rate FROM rates")
def _(spark, d):
    folder = tables.scratch(spark, "rates")

    def put(frame: pd.DataFrame) -> pd.DataFrame:
        names, text = [c for c in frame.columns if c not in ("fix_date", "month")], io.StringIO()
        lines = csv.writer(text)
        lines.writerow(["Date", *names])
        lines.writerows([[r.fix_date.isoformat(), *(getattr(r, c) for c in names)] for r in frame.sort_values("fix_date").itertuples()])
        # a line that has no day is no row
        lines.writerow(["end of month", *("1" for _ in names)])
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("rates.csv", text.getvalue())
        put_file(folder, f"{frame.month.iloc[0]}.zip", out.getvalue())
        return pd.DataFrame({"n": [len(frame)]})

    wide = reference_rates_wide(spark, d).withColumn("month", F.date_format("fix_date", "yyyy-MM"))
    wide.groupBy("month").applyInPandas(put, "n long").agg(F.sum("n")).collect()
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return rates_from_zip(files).withColumn("fix_date", F.col("fix_date").cast("string"))


@query("releases_kept", f"WITH {RELEASES} SELECT * FROM re WHERE released_at < {RELEASES_FROM + 300 * DAY}")
def _(spark, d):
    path = f"{tables.scratch(spark, 'releases')}/kept"
    built = macro.release_events(vintages(spark, d), RELEASES_FROM, RELEASES_TO)
    store.kept_releases(spark, path, built, RELEASES_FROM, RELEASES_TO)
    # what is kept is read, and not built again
    rows = store.kept_releases(spark, path, built.where("false"), RELEASES_FROM, RELEASES_FROM + 300 * DAY)
    return rows.select("series_id", "released_at", period(), "first_print", "final_value", F.round("surprise_first", 5).alias("surprise_first"), F.round("surprise_final", 5).alias("surprise_final"))


@query("session_opened", f"""WITH t AS (SELECT * FROM tick WHERE instrument IN ('click', 'view') AND ts >= {FROM_US + 5 * DAY} AND ts < {FROM_US + 9 * DAY})
SELECT relation, CASE relation WHEN 'tick_raw' THEN (SELECT count(*) FROM t) WHEN 'bar_1m' THEN (SELECT count(DISTINCT (instrument, source, ts - ts % {MINUTE})) FROM t) ELSE 0 END AS "rows" FROM (SELECT unnest({list(SCHEMAS)}) AS relation)""")
def _(spark, d):
    folder, quotes = tables.scratch(spark, "session"), ticks(spark, d)
    for feed in ("feed_a", "feed_b"):
        store.append_hours(quotes.where(F.col("source") == feed), folder)
    tables.append(bars.bars_from_ticks(quotes), folder, "bar_1m")
    # relations that were never stored are there, without rows
    inside, out = store.open_session(spark, folder, instruments=["click", "view"], start=FROM_US + 5 * DAY, end=FROM_US + 9 * DAY), None
    for name, rows in inside.items():
        counted = rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("relation"), "rows")
        out = counted if out is None else out.unionByName(counted)
    return out


@query("hours_appended", "SELECT instrument, ts, bid, ask, source, seq FROM tick UNION ALL SELECT instrument, ts, bid, ask, source, seq FROM tick WHERE source = 'feed_b'")
def _(spark, d):
    folder, quotes = tables.scratch(spark, "appended"), ticks(spark, d)
    # an append keeps repeats: an hour that comes twice is there twice
    for rows in (quotes, quotes.where("source = 'feed_b'")):
        store.append_hours(rows, folder)
    return tables.read(spark, folder, "tick_raw").select("instrument", "ts", "bid", "ask", "source", "seq")


@query("rates_stored", f"WITH {RATES} SELECT fix_date, currency, CASE WHEN day(CAST(fix_date AS DATE)) % 2 = 0 THEN rate ELSE rate + 1 END AS rate FROM rates")
def _(spark, d):
    folder, rates = tables.scratch(spark, "rates"), unpivot_rates(reference_rates_wide(spark, d))
    keys = ["fix_date", "currency"]
    store.upsert_stored(spark, folder, "reference_rate", rates.withColumn("rate", F.col("rate") + 1), keys)
    for _ in range(2):
        store.upsert_stored(spark, folder, "reference_rate", rates.where("day(fix_date) % 2 = 0"), keys)
    return tables.read(spark, folder, "reference_rate").withColumn("fix_date", F.col("fix_date").cast("string"))


#: What is stored first has rates that are off by one; those of two instruments are then stored anew.
OFF = "CASE WHEN f.instrument IN ('click', 'view') THEN 0 ELSE 1 END"


@query("drift_stored", f"""WITH drift AS ({ORACLE_SQL["drift_anchor"].replace("- rate)", f"- (rate + {OFF}))").replace("fix_at, rate, round", f"fix_at, rate + {OFF} AS fix, round")})
SELECT CAST(CAST(make_timestamp(fix_at) AS DATE) AS VARCHAR) AS fix_date, instrument, round(fix, 6) AS fix, mean_mid, ticks, diff_pips FROM drift""")
def _(spark, d):
    folder, quotes = tables.scratch(spark, "drift"), ticks(spark, d)
    fixes = fixes_of(quotes)

    def observed(rows: DataFrame) -> DataFrame:
        found = monitors.drift_anchor(rows, quotes, 0.01, HOUR, digits=6)
        return found.select(F.expr(f"date_from_unix_date(int(fix_at div {DAY}))").alias("fix_date"), "instrument", F.col("rate").alias("fix"), "mean_mid", "ticks", "diff_pips")

    keys = ["fix_date", "instrument"]
    store.upsert_stored(spark, folder, "drift_observation", observed(fixes.withColumn("rate", F.col("rate") + 1)), keys)
    store.upsert_stored(spark, folder, "drift_observation", observed(fixes.where("instrument IN ('click', 'view')")), keys)
    rows = tables.read(spark, folder, "drift_observation")
    return rows.select(F.col("fix_date").cast("string").alias("fix_date"), "instrument", F.round("fix", 6).alias("fix"), F.round("mean_mid", 9).alias("mean_mid"), "ticks", "diff_pips")


@query("windows_overlapping", f"""WITH w AS (SELECT instrument, min(ts) AS span_start, min(ts) + count(*) * {20 * MINUTE} AS span_end FROM tick GROUP BY instrument, ts - ts % {HOUR}),
b AS (SELECT *, max(span_end) OVER (PARTITION BY instrument ORDER BY span_start, span_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w) SELECT instrument, span_start, span_end, before FROM b WHERE before > span_start""")
def _(spark, d):
    hours = ticks(spark, d).groupBy("instrument", floor_to("ts", HOUR).alias("hour")).agg(F.min("ts").alias("span_start"), F.count("*").alias("n"))
    windows = hours.select("instrument", "span_start", (F.col("span_start") + F.col("n") * 20 * MINUTE).alias("span_end"))
    return sessions.overlapping(windows, ["instrument"])


@query("vintages_digested", "SELECT CAST(vintage_seq AS VARCHAR) AS name, CASE WHEN value IS NULL THEN 'MISSING' ELSE substr(sha256(series_id || '|' || CAST(ref_period AS VARCHAR) || '|' || CAST(known_at AS VARCHAR)), 1, 16) END AS digest FROM vintage")
def _(spark, d):
    text = F.concat_ws("|", "series_id", "ref_period", "known_at")
    return store.file_digests(vintages(spark, d).select(F.col("vintage_seq").cast("string").alias("name"), F.when(F.col("value").isNotNull(), text.cast("binary")).alias("content")))


def rule_rows() -> str:
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join(f"({', '.join(map(quoted, rule))})" for rule in holidays.RULES)


#: Easter here by the epact: the Sunday after the full moon that it gives.
BY_RULE = f"""ru AS (SELECT * FROM (VALUES {rule_rows()}) AS v(currency, name, month, day, weekday, nth, after, since, moved)),
ye AS (SELECT CAST(unnest(range(year(min(o_orderdate)) - 1, year(max(o_orderdate)) + 2)) AS INT) AS y FROM orders),
ep AS (SELECT y, (11 * (y % 19) + 91 - (3 * (y // 100 + 1) // 4 - 12) + (8 * (y // 100 + 1) + 5) // 25 - 5) % 30 AS e0 FROM ye),
ea AS (SELECT y, CASE WHEN e0 = 24 OR (e0 = 25 AND y % 19 >= 11) THEN e0 + 1 ELSE e0 END AS e FROM ep),
fm AS (SELECT y, make_date(y, 3, 1) + CAST(CASE WHEN 44 - e < 21 THEN 44 - e + 30 ELSE 44 - e END - 1 AS INT) AS moon FROM ea),
su AS (SELECT y, moon + CAST(7 - isodow(moon) % 7 AS INT) AS easter FROM fm),
da AS (SELECT r.*, y, CASE WHEN after IS NOT NULL THEN easter + CAST(after AS INT)
  WHEN weekday IS NOT NULL THEN ([x for x in range(CAST(make_date(y, month, 1) AS TIMESTAMP), CAST(make_date(y, month, 1) AS TIMESTAMP) + INTERVAL 1 MONTH, INTERVAL 1 DAY) if isodow(x) = weekday + 1])[nth]
  ELSE make_date(y, month, day) END AS dt FROM ru r JOIN su ON since IS NULL OR y >= since),
ob AS (SELECT currency, CAST(dt AS DATE) AS d, name FROM da UNION ALL
  SELECT currency, CAST(dt AS DATE) + CASE WHEN moved = 'later' THEN 2 WHEN isodow(dt) = 7 THEN 1 WHEN moved = 'monday' THEN 2 ELSE -1 END, name || ' (observed)' FROM da WHERE moved IS NOT NULL AND isodow(dt) >= 6)"""


@query("holidays_by_rule", f"""WITH {BY_RULE}, n AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS vintages FROM orders GROUP BY 1)
SELECT currency, CAST(ob.d AS VARCHAR) AS holiday_date, name, coalesce(vintages, 0) AS vintages FROM ob LEFT JOIN n USING (d) WHERE year(ob.d) BETWEEN (SELECT min(year(o_orderdate)) FROM orders) AND (SELECT max(year(o_orderdate)) FROM orders)""")
def _(spark, d):
    known = vintages(spark, d).groupBy(day_of("known_at").alias("holiday_date")).agg(F.count("*").alias("vintages"))
    ends = known.agg(F.min(F.year("holiday_date")), F.max(F.year("holiday_date"))).first()
    rows = holidays.holidays_by_rule(spark, *ends).join(known, "holiday_date", "left")
    return rows.select("currency", F.col("holiday_date").cast("string").alias("holiday_date"), "name", F.coalesce("vintages", F.lit(0)).alias("vintages"))
