"""A store of titled pages in a folder: one row file for each revision, the latest counts.

Every write appends a revision, so readers never see half a page. The store is a table
(title, content, rev, user, timestamp) that Spark reads and writes; no network is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim_space
from ..operators.diff import content_changed

PAGE = "title string, content string, last_rev_id bigint, last_rev_user string, last_rev_timestamp string"


class PageNotFound(LookupError):
    """The store has no page of this title."""


class EditRefused(ValueError):
    """The new content is missing, or not one row."""


class PageStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def revisions(self) -> DataFrame:
        return self.spark.read.schema(PAGE).parquet(self.path)

    def pages(self) -> DataFrame:
        """The latest revision of every page."""
        row = F.struct("content", "last_rev_id", "last_rev_user", "last_rev_timestamp")
        return self.revisions().groupBy("title").agg(F.max_by(row, F.col("last_rev_id")).alias("r")).select("title", "r.*")

    def get(self, title: str) -> DataFrame:
        """One row: the page; an error if there is none."""
        found = self.pages().where(F.col("title") == title)
        if found.isEmpty():
            raise PageNotFound(title)
        return found

    def get_json(self, title: str) -> DataFrame:
        """One row, `value`: the page's trimmed content as a variant."""
        return self.get(title).select(F.parse_json(trim_space(F.col("content"))).alias("value"))

    def create(self, pages: DataFrame, user: str = "import") -> None:
        """A first revision of each row (title, content)."""
        self._write(pages.select("title", "content", F.lit(1).cast("long").alias("last_rev_id")), user)

    def _write(self, rows: DataFrame, user: str) -> None:
        stamped = rows.withColumns({"last_rev_user": F.lit(user), "last_rev_timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")})
        stamped.write.mode("append").parquet(self.path)

    def edit(self, title: str, content: DataFrame, user: str = "bot", position: str = "replace", confirmed: bool = False, json: bool = False) -> str:
        """Replace a page by the one row's `content`, or add it at the page's end or start.

        Without confirmation nothing is written; null is never written. Returns unchanged, pending or written."""
        content = content.select("content").limit(2)  # a page is one object
        if [r.known for r in content.select(F.col("content").isNotNull().alias("known")).collect()] != [True]:
            raise EditRefused(f"{title}: one row of content that is not null is needed")
        old = self.get(title).select(F.col("content").alias("old"), "last_rev_id")
        both = old.crossJoin(content.select(F.col("content").alias("new")))  # one row each
        text = {"replace": F.col("new"), "append": F.concat("old", "new"), "prepend": F.concat("new", "old")}[position]
        due = both.select(F.lit(title).alias("title"), text.alias("content"), (F.col("last_rev_id") + 1).alias("last_rev_id"), content_changed(F.col("old"), text, json).alias("due")).where("due").drop("due")
        if due.isEmpty():
            return "unchanged"
        if not confirmed:
            return "pending"
        self._write(due, user)
        return "written"
