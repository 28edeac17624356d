"""The ledger's statements as SQL text with named parameters, on a table of the session catalog.

Values only ever travel as parameters and names as identifiers, so no text can become a statement. Inserts and updates are sets of rows: a temporary view of
uploads or changes, or one row of parameters. An update is appended; the select takes each id's last state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CREATE = """CREATE TABLE IF NOT EXISTS IDENTIFIER(:table) (
    scan_id BIGINT, seq BIGINT, status STRING, filename STRING, text_content STRING, docx_path STRING, event_ts TIMESTAMP) USING parquet LOCATION '{location}'"""
INSERT = """INSERT INTO IDENTIFIER(:table) SELECT scan_id, 0, :pending, filename, CAST(NULL AS STRING), CAST(NULL AS STRING), at FROM IDENTIFIER(:uploads)"""
INSERT_ONE = """INSERT INTO IDENTIFIER(:table) SELECT :id, 0, :pending, :filename, CAST(NULL AS STRING), CAST(NULL AS STRING), current_timestamp()"""
UPDATE = """INSERT INTO IDENTIFIER(:table) SELECT c.scan_id, known.seq + 1, c.status, CAST(NULL AS STRING), c.text_content, c.docx_path, c.at
    FROM IDENTIFIER(:changes) c JOIN (SELECT scan_id, max(seq) AS seq FROM IDENTIFIER(:table) GROUP BY scan_id) known ON known.scan_id = c.scan_id"""
UPDATE_ONE = """INSERT INTO IDENTIFIER(:table) SELECT :id, max(seq) + 1, :status, CAST(NULL AS STRING), :text, :path, current_timestamp()
    FROM IDENTIFIER(:table) WHERE scan_id = :id HAVING count(*) > 0"""
ALL = """SELECT id, filename, s.status, created_at, s.event_ts AS updated_at, s.text_content, s.docx_path FROM (
    SELECT scan_id AS id, max(filename) AS filename, min(event_ts) AS created_at, max_by(struct(status, text_content, docx_path, event_ts), seq) AS s
    FROM IDENTIFIER(:table) {where} GROUP BY scan_id)"""
ONE = ALL.format(where="WHERE scan_id = :id")


class Statements:
    """Create, insert, update and select on the table ``name``, which lies at ``location``."""

    def __init__(self, spark: SparkSession, name: str, location: str):
        self.spark, self.name = spark, name
        # A location can't be a parameter; quotes in it are doubled.
        self._run(CREATE.format(location=location.replace("\\", "\\\\").replace("'", "\\'")))

    def _run(self, statement: str, **values) -> DataFrame:
        return self.spark.sql(statement, args={"table": self.name, **values})

    def insert(self, uploads: str) -> None:
        """Pending scans of a view (scan_id, filename, at)."""
        self._run(INSERT, pending="Pending", uploads=uploads)

    def insert_one(self, scan_id: int, filename: str) -> None:
        self._run(INSERT_ONE, pending="Pending", id=scan_id, filename=filename)

    def update(self, changes: str) -> None:
        """Changes of a view (scan_id, status, text_content, docx_path, at), one for each id; unknown ids change nothing."""
        self._run(UPDATE, changes=changes)

    def update_one(self, scan_id: int, status: str, text: str | None = None, path: str | None = None) -> None:
        self._run(UPDATE_ONE, id=scan_id, status=status, text=text, path=path)

    def select(self, scan_id: int | None = None) -> DataFrame:
        return self._run(ALL.format(where="")) if scan_id is None else self._run(ONE, id=scan_id)
