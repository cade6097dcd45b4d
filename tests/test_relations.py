"""Relations of many statements at once, against each statement parsed by itself."""

from plumbline.plans import dashboards
from plumbline.plans.dashboards import is_approved, relations_of, relations_read

ODD = [
    "SELECT 'a' FROM `x`, t", "SELECT 'b' FROM `y`, t", "SELECT `x`.c FROM `x` JOIN `s`.`x` ON `x`.c = 'it''s' AND d = '`q`'",
    "WITH `T` AS (SELECT 1) SELECT * FROM t, `T`, `t`", "WITH t AS (SELECT 1) SELECT * FROM `t`, `u`",
    "WITH `a` AS (SELECT * FROM `b`) SELECT * FROM `A`", "SELECT * FROM `it's` WHERE x = 'y'",
    "SELECT 1 FROM `SELECT 'b'c` WHERE v = 'w'", r"SELECT 'x\'' , `a` FROM `a`", 'SELECT "`a`" FROM `b`',
    "SELECT 1 FROM `a``b`", "SELECT 1 FROM `a` -- `c'\n, `d`", "SELECT 1 /* `e` */ FROM `e`",
    "SELECT * FROM `range`(3), `f`(2), g(1)", "SELECT r'`a`' FROM `b`",
    "SELECT DATE '2024-01-01' FROM IDENTIFIER('a') WHERE d = DATE '2024-01-02'", "SELECT * FROM default.`t`, no.`t`, csv.`/x`",
    "SELECT * FROM `__name_0__`, __name_3__",
    "WITH `x` AS (SELECT 1) SELECT 1 FROM `x` WHERE EXISTS (SELECT 1 FROM `x` WHERE k IN (SELECT k FROM `z`))",
]


def test_relations_of_statements_are_those_of_each(spark):
    approved = ["t", "x"]
    expected = sorted(
        (k, ".".join(name), is_approved(spark, name, approved)) for k, sql in enumerate(ODD) for name in relations_read(spark, sql))
    found = relations_of(spark.createDataFrame(list(enumerate(ODD)), "k long, sql string"), ["k"], "sql", approved)
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_statements_of_one_shape_are_parsed_once(spark, monkeypatch):
    parsed = []

    def read(session, sql):
        parsed.append(sql)
        return relations_read(session, sql)

    monkeypatch.setattr(dashboards, "relations_read", read)
    monkeypatch.setattr(dashboards, "SHAPES_AT_ONCE", 2)
    rows = [(k, f"SELECT 'v{k}' FROM IDENTIFIER('i{k}'), `n{k}` a, `m` b, u WHERE k > '{k}'") for k in range(300)]
    rows += [(k, f"SELECT 1 FROM `n{k}` -- {k}") for k in range(300, 303)]
    found = relations_of(spark.createDataFrame(rows, "id long, sql string"), ["id"], "sql", ["N7", "U"])
    names = {k: set() for k, _ in rows}
    for r in found.collect():
        names[r.id].add((r.relation, r.approved))
    for k in range(300):
        assert names[k] == {(f"n{k}", k == 7), ("m", False), ("u", True), ("IDENTIFIER", False)}
    assert names[301] == {("n301", False)}
    assert len(parsed) == 4
