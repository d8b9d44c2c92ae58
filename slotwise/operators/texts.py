"""Word and match-log reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slotwise.functions import text


def word_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each word occurs over whole texts; counting starts before the shuffle."""
    return df.select(F.explode(text.words(F.col(column))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def index_by_initial(df: DataFrame, column: str) -> DataFrame:
    """Words and their counts under their initial letter, as rows ``initial, word, n``."""
    return word_counts(df, column).select(F.substring("word", 1, 1).alias("initial"), "word", "n")


def split_convertible(df: DataFrame, column: str) -> DataFrame:
    """One row per element of an array column, with its float value or NULL."""
    return df.withColumn("item", F.explode(column)).withColumn("number", text.to_float_or_null(F.col("item")))


# A whole number of a score, and a name with something in it.
GOALS = r"^\s*(\+?[0-9]{1,18})\s*\z"
NAME = r"\S"


def parse_matches(lines: DataFrame, column: str = "value") -> DataFrame:
    """``home<TAB>g1-g2<TAB>away`` lines; malformed lines are skipped.

    A line is cut once at its tabs and its score once at the dash: both cuts are lambda variables, and the match is one struct that is
    made in a generator, which later filters and projections don't copy.
    """
    number = lambda goals: F.regexp_replace(goals, r"\s", "").cast("bigint")

    def match(f: Column, g: Column) -> Column:
        home, away, scored, conceded = F.get(f, F.lit(0)), F.get(f, F.lit(2)), F.get(g, F.lit(0)), F.get(g, F.lit(1))
        valid = (F.size(f) == 3) & (F.size(g) == 2) & scored.rlike(GOALS) & conceded.rlike(GOALS) & home.rlike(NAME) & away.rlike(NAME)
        return F.when(valid, F.struct(
            F.trim(home).alias("home"), number(scored).alias("home_goals"), F.trim(away).alias("away"), number(conceded).alias("away_goals")
        ))

    cut = F.split(F.regexp_replace(column, r"^\s+|\s+\z", ""), "\t", -1)
    found = F.transform(F.array(cut), lambda f: F.get(F.transform(F.array(F.split(F.get(f, F.lit(1)), "-", -1)), lambda g: match(f, g)), F.lit(0)))
    return lines.select(F.explode(F.array(F.get(found, F.lit(0)))).alias("match")).where("match is not null").select("match.*")


def team_rows(matches: DataFrame) -> DataFrame:
    """One row per team and match: goals for and against."""
    side = lambda team, scored, conceded: F.struct(
        F.col(team).alias("team"), F.col(scored).alias("gf"), F.col(conceded).alias("ga")
    )
    both = F.array(side("home", "home_goals", "away_goals"), side("away", "away_goals", "home_goals"))
    return matches.select(F.explode(both).alias("t")).select("t.*")


def league_table(matches: DataFrame) -> DataFrame:
    """Wins, draws, losses, goals and points (3/1/0), best team first."""
    won, drawn = F.col("gf") > F.col("ga"), F.col("gf") == F.col("ga")
    n = lambda cond: F.count(F.when(cond, 1))
    table = team_rows(matches).groupBy("team").agg(
        n(won).alias("won"), n(drawn).alias("drawn"), n(~won & ~drawn).alias("lost"),
        F.sum("gf").alias("gf"), F.sum("ga").alias("ga"),
    )
    points = table.withColumn("points", 3 * F.col("won") + F.col("drawn"))
    return points.orderBy(F.desc("points"), F.desc("gf"), "team")


def league_leaders(matches: DataFrame) -> DataFrame:
    """Team with most goals scored and team with most conceded (first name on ties)."""
    totals = team_rows(matches).groupBy("team").agg(F.sum("gf").alias("gf"), F.sum("ga").alias("ga"))
    first = lambda c: F.min_by("team", F.struct(-F.col(c), F.col("team")))
    return totals.agg(first("gf").alias("top_scorer"), first("ga").alias("most_scored_against"))
