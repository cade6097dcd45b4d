"""Reading and guarding of generated replies, as Column expressions over text columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Safety words, blocked words, statement starts and readable objects.
SAFE, REVIEW, UNSAFE, UNKNOWN = "SAFE_TO_AUTOMATE", "REQUIRES_HUMAN_REVIEW", "UNSAFE", "UNKNOWN"
WRITE_BLOCKED = ["DROP ", "TRUNCATE ", "ALTER ", "GRANT ", "REVOKE ", "CREATE ", "DELETE FROM"]
WRITE_STARTS = ["UPDATE ", "INSERT ", "MERGE "]
READ_BLOCKED = [
    "INSERT ", "UPDATE ", "DELETE ", "MERGE ", "DROP ", "TRUNCATE ", "ALTER ", "CREATE ", "GRANT ",
    "REVOKE ", "CALL ", "EXECUTE ", "PUT ", "REMOVE ", "COPY ",
]
READ_STARTS = ["SELECT", "WITH"]
READABLE_OBJECTS = [
    "V_OVERALL_HEALTH", "V_TABLE_HEALTH_DASHBOARD", "V_CHECK_SUMMARY", "DQ_RUN_LOG", "TABLE_PROFILES",
    "COLUMN_PROFILES", "DISTRIBUTION_SNAPSHOTS", "DQ_CHECK_LIBRARY", "V_PENDING_REMEDIATIONS",
    "V_REMEDIATION_HISTORY", "AI_ANALYSIS_CACHE",
]
SHORTEST_SQL = 10

FENCED_SQL = r"(?s)```sql[^\n]*\n(.*?)```"


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind, line ends included."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def classify_safety(reply: Column, whole_words: bool = True) -> Column:
    """Safety class of a reply.

    The safe word must stand alone, and a negated one asks for review. Without ``whole_words`` the first word found as a
    substring decides, in the order safe, review, unsafe, so that a negated safe word counts as safe.
    """
    upper = F.upper(reply)
    if not whole_words:
        return (
            F.when(F.contains(upper, F.lit(SAFE)), SAFE)
            .when(F.contains(upper, F.lit(REVIEW)), REVIEW)
            .when(F.contains(upper, F.lit(UNSAFE)), UNSAFE)
            .otherwise(UNKNOWN)
        )
    alone = upper.rlike(rf"(^|[^A-Z_]){SAFE}($|[^A-Z_])")
    negated = upper.rlike(rf"(^|[^A-Z_])(NOT|UN|NON)[ _-]*{SAFE}") | F.contains(upper, F.lit(f"UN{SAFE}"))
    return (
        F.when(negated | F.contains(upper, F.lit(REVIEW)), REVIEW)
        .when(alone, SAFE)
        .when(F.contains(upper, F.lit(UNSAFE)), UNSAFE)
        .otherwise(UNKNOWN)
    )


def classify_safety_like(reply: Column) -> Column:
    """The form used by the views: LIKE patterns, in which an underscore stands for any character."""
    upper = F.upper(reply)
    return (
        F.when(upper.like(f"%{SAFE}%"), SAFE)
        .when(upper.like(f"%{REVIEW}%"), REVIEW)
        .when(upper.like(f"%{UNSAFE}%"), UNSAFE)
        .otherwise(UNKNOWN)
    )


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _block_from_lines(reply: Column, start: str) -> Column:
    """Lines from the first that matches ``start`` to the next empty or fence line, joined by blanks."""
    def from_first(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda x: F.upper(x).rlike(start)), F.lit(True))
        return bind(first.cast("int"), lambda at: F.when(at > 0, F.slice(lines, at, F.size(lines))))

    def to_stop(rest: Column) -> Column:
        stop = F.array_position(F.transform(rest, lambda x: (x == "") | (x == "```")), F.lit(True))
        block = bind(stop.cast("int"), lambda at: F.when(at > 0, F.slice(rest, F.lit(1), at - 1)).otherwise(rest))
        return F.array_join(block, " ")

    lines = F.transform(F.split(reply, "\n"), strip)
    return bind(bind(lines, from_first), to_stop)


def _extract(reply: Column, start: str) -> Column:
    fenced = strip(F.regexp_extract(reply, FENCED_SQL, 1))
    found = bind(fenced, lambda f: F.when(F.length(f) > 0, f).otherwise(_block_from_lines(reply, start)))
    return bind(found, lambda sql: F.when(F.length(sql) >= SHORTEST_SQL, sql))


def extract_statement(reply: Column) -> Column:
    """The write statement of a reply: its first fenced SQL block, else its first statement lines."""
    return _extract(reply, r"\A(UPDATE|INSERT|MERGE) ")


def extract_query(reply: Column) -> Column:
    """The read statement of a reply, without a trailing semicolon."""
    return F.regexp_replace(_extract(reply, r"\ASELECT"), r";\s*\z", "")


def _first_blocked(upper: Column, words: list[str]) -> Column:
    """The first word of the list that occurs, by list order; NULL when none does."""
    found = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(upper, w))
    return F.trim(F.get(found, F.lit(0)))


def _starts(upper: Column, starts: list[str]) -> Column:
    test = F.lit(False)
    for start in starts:
        test = test | upper.startswith(start)
    return test


def guard_statement(statement: Column) -> Column:
    """``status`` and ``message`` for a write statement; only controlled changes pass."""
    def judged(sql: Column, upper: Column, blocked: Column) -> Column:
        return (
            F.when(sql.isNull(), _verdict("ERROR", F.lit("no statement found")))
            .when(blocked.isNotNull(), _verdict("BLOCKED", F.concat(F.lit("blocked keyword: "), blocked)))
            .when(~_starts(upper, WRITE_STARTS), _verdict("BLOCKED", F.lit("not UPDATE, INSERT or MERGE")))
            .otherwise(_verdict("ACCEPTED", F.lit(None).cast("string")))
        )

    return bind(statement, lambda sql: bind(
        F.upper(strip(sql)), lambda upper: bind(
            _first_blocked(upper, WRITE_BLOCKED), lambda blocked: judged(sql, upper, blocked))))


def _verdict(status: str, message: Column) -> Column:
    return F.struct(F.lit(status).alias("status"), message.alias("message"))


def referenced_objects(sql: Column) -> Column:
    """Names after FROM and JOIN, as written."""
    return F.regexp_extract_all(sql, F.lit(r"(?i)(?:FROM|JOIN)\s+([A-Za-z0-9_.]+)"), F.lit(1))


def unapproved_objects(sql: Column, approved: list[str] | None = None) -> Column:
    """Referenced names whose last part is not on the list."""
    allowed = F.array(*[F.lit(a) for a in (approved or READABLE_OBJECTS)])
    return F.filter(
        referenced_objects(sql),
        lambda name: ~F.array_contains(allowed, F.element_at(F.split(F.upper(name), r"\."), -1)),
    )


def has_second_statement(sql: Column) -> Column:
    """A semicolon outside single quotes; an unclosed quote hides the rest."""
    return F.contains(F.regexp_replace(sql, r"'[^']*('|\z)", ""), F.lit(";"))


def guard_query(query: Column, approved: list[str] | None = None) -> Column:
    """``status`` and ``message`` for a read query."""
    def judged(sql: Column, upper: Column, blocked: Column, foreign: Column) -> Column:
        return (
            F.when(sql.isNull(), _verdict("ERROR", F.lit("no query found")))
            .when(~_starts(upper, READ_STARTS), _verdict("BLOCKED", F.lit("not SELECT or WITH")))
            .when(blocked.isNotNull(), _verdict("BLOCKED", F.concat(F.lit("blocked keyword: "), blocked)))
            .when(has_second_statement(sql), _verdict("BLOCKED", F.lit("several statements")))
            .when(foreign.isNotNull(), _verdict("BLOCKED", F.concat(F.lit("unapproved object: "), foreign)))
            .otherwise(_verdict("ACCEPTED", F.lit(None).cast("string")))
        )

    return bind(query, lambda sql: bind(
        F.upper(strip(sql)), lambda upper: bind(
            _first_blocked(upper, READ_BLOCKED), lambda blocked: bind(
                F.get(unapproved_objects(sql, approved), F.lit(0)),
                lambda foreign: judged(sql, upper, blocked, foreign)))))
