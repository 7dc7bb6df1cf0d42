"""Scripts of statements against sqlite3: the same errors, results and final tables."""

import sqlite3

import pytest

from quillsql.client import Connection
from quillsql.engine import Engine
from quillsql.errors import ConstraintError, SqlError

SCRIPTS = {
    "insert": (
        """create table t(id integer primary key, n text, v integer default 7)
insert into t(n) values('a'),('b')
insert into t(id,n,v) values(10,'c',1)
insert into t(n,v) values('d',2) returning id, n, v*2 as w
update t set v=v+1, n=n||'!' where v>1 returning *
delete from t where n='c' returning id
insert into t(id) values(1)
insert or ignore into t(id,n) values(1,'z'),(50,'y')
insert or replace into t(id,n) values(1,'z')
replace into t(n) values('last')""",
        ["select * from t"],
    ),
    "conflicts": (
        """create table u(id integer primary key, e text unique, name text)
insert into u values(1,'a','x'),(2,'b','y')
insert into u values(3,'a','q')
insert or ignore into u values(3,'a','q'),(4,'c','r'),(5,'c','s')
insert or replace into u values(9,'a','new'),(2,'c','both')
insert into u values(20,'n1','1'),(21,'n1','2') on conflict(e) do update set name=name||excluded.name
insert into u values(30,'c','zz') on conflict do nothing
update u set e='a' where e='n1'
update or ignore u set e='a' where e='n1'
update or replace u set e='a' where e='n1'""",
        ["select * from u"],
    ),
    "checks": (
        """create table p(id integer primary key, x int check (x > 0), y text not null)
insert into p values(1,1,'a')
insert into p values(2,-1,'a')
insert into p values(2,null,'b')
insert into p(id,x) values(3,3)
insert or ignore into p values(4,-4,'q'),(5,5,'w')
update p set x=-1 where id=1""",
        ["select * from p"],
    ),
    "foreign_keys": (
        """pragma foreign_keys=on
create table p(id integer primary key)
create table c(id integer primary key, pid int references p(id) on delete cascade on update cascade)
create table d(id integer primary key, cid int references c(id) on delete set null)
insert into p values(1),(2),(3)
insert into c values(10,1),(11,2),(12,null)
insert into c values(13,9)
insert into d values(100,10),(101,11)
update p set id=22 where id=2
delete from p where id=1""",
        ["select * from p", "select * from c", "select * from d"],
    ),
    "triggers": (
        """create table t(id integer primary key, v int)
create table log(id integer primary key, msg text)
create trigger a after insert on t begin insert into log(msg) values('ins '||new.id||' '||new.v); end
create trigger b after update of v on t when new.v>old.v begin insert into log(msg) values('up '||old.v||'>'||new.v); end
insert into t values(1,5),(2,6)
update t set v=v+1 where id=1
update t set v=v-1 where id=2
create view vw as select id, v from t
create trigger iv instead of insert on vw begin insert into t values(new.id, new.v*10); end
insert into vw values(7,7)""",
        ["select msg from log", "select * from t"],
    ),
    "transactions": (
        """create table t(x int)
begin
insert into t values(1)
savepoint a
insert into t values(2)
savepoint b
insert into t values(3)
rollback to a
insert into t values(4)
release a
commit
begin
delete from t
rollback
rollback""",
        ["select * from t"],
    ),
    "definitions": (
        """create table t(a int, b int, c int as (a+b), d int generated always as (c*2) stored)
insert into t(a,b) values(1,2),(3,4)
insert into t(a,c) values(1,2)
alter table t add column e text default 'q'
alter table t rename column b to bb
alter table t rename to t2
insert into t2(a,bb) values(5,5)
create table if not exists t2(z int)
create table t2(z int)
drop table nope
drop table if exists nope
create view v(x,y) as select a, bb from t2 where a > 1""",
        ["select * from t2", "select * from v", "select type, name, tbl_name from sqlite_master"],
    ),
}


@pytest.mark.parametrize("name", SCRIPTS)
def test_script(spark, name):
    script, queries = SCRIPTS[name]
    engine, oracle = Engine(spark), sqlite3.connect(":memory:", isolation_level=None)
    for text in script.splitlines():
        try:
            want = sorted(oracle.execute(text).fetchall(), key=repr)
        except sqlite3.Error:
            with pytest.raises(SqlError):
                engine.sql(text)
            continue
        got = engine.sql(text)
        if "returning" in text:
            assert sorted(map(tuple, got.collect()), key=repr) == want
    for text in queries:
        assert sorted(engine.rows(text), key=repr) == sorted(oracle.execute(text).fetchall(), key=repr)


def test_tables_outlive_the_engine(spark, tmp_path):
    first = Engine(spark, str(tmp_path / "db"))
    first.sql("create table t(id integer primary key, s text unique); insert into t(s) values ('a'), ('b'); create view v as select s from t")
    again = Engine(spark, str(tmp_path / "db"))
    assert again.rows("select id, s from t order by id") == [(1, "a"), (2, "b")]
    assert sorted(again.rows("select * from v")) == [("a",), ("b",)]
    with pytest.raises(ConstraintError):
        again.sql("insert into t(s) values ('a')")


def test_failed_statement_changes_nothing(spark):
    engine = Engine(spark)
    engine.sql("create table t(x int not null)")
    with pytest.raises(ConstraintError):
        engine.sql("insert into t values (1), (null)")
    assert engine.rows("select count(*) from t") == [(0,)]


def test_client(spark):
    connection = Connection(spark)
    assert connection.exec("create table t(id integer primary key, s text); insert into t(s) values ('a'), ('b')") == 2
    assert connection.last_insert_id() == 2
    statement = connection.prepare("select id, s from t where id >= ? order by id")
    assert statement.execute([1]).fetch_all("assoc") == [{"id": 1, "s": "a"}, {"id": 2, "s": "b"}]
    assert statement.bind(1, 2).execute().fetch() == (2, "b")
    assert connection.query("select id, s from t").fetch_all("pair") == {1: "a", 2: "b"}
    assert list(connection.query("select s from t order by s")) == [("a",), ("b",)]
    connection.begin()
    connection.exec("delete from t")
    connection.rollback()
    assert connection.query("select count(*) from t").fetch_column() == 2


def test_upsert_of_many_rows_of_a_key_is_one_step(spark, monkeypatch):
    from quillsql.operators import dml

    rows = [(f"'k{i % 3}'" if i % 50 else "NULL", "NULL" if i == 151 else i, i % 7) for i in range(400)]
    values = ",".join(f"({k},{n},{v})" for k, n, v in rows)
    script = [
        "create table c(k text primary key, n int, last int)", "insert into c values('k1', 5, 5)",
        f"insert into c values{values} on conflict(k) do update set n = excluded.n * 2 + n, last = excluded.last - 1",
        f"insert into c values{values} on conflict(k) do nothing",
    ]
    calls, real = [], dml.replace_rows
    monkeypatch.setattr(dml, "replace_rows", lambda *a, **k: calls.append(1) or real(*a, **k))
    engine, base = Engine(spark), sqlite3.connect(":memory:")
    for s in script:
        engine.sql(s)
        base.execute(s)
    query = "select k, n, last from c"
    assert sorted(map(tuple, engine.sql(query).collect()), key=repr) == sorted(base.execute(query).fetchall(), key=repr)
    assert len(calls) <= 2
    assert engine.changes == base.execute("select changes()").fetchone()[0]


def test_upsert_whose_steps_differ_still_folds_in_order(spark):
    script = ["create table c(k int primary key, n int)", "insert into c values(1,1),(1,2),(1,5),(2,3) on conflict(k) do update set n = n * excluded.n - 1", "insert into c values(1,1),(1,2),(2,9) on conflict(k) do update set n = n + excluded.n where n < 15"]
    engine, base = Engine(spark), sqlite3.connect(":memory:")
    for s in script:
        engine.sql(s)
        base.execute(s)
    assert sorted(map(tuple, engine.sql("select * from c").collect())) == sorted(base.execute("select * from c").fetchall())


def test_missing_row_ids_follow_the_largest_at_any_size(spark):
    """More rows than one driver's loop took, over several stretches."""
    engine, base = Engine(spark), sqlite3.connect(":memory:")
    base.execute("create table t(id integer primary key, v int)")
    engine.sql("create table t(id integer primary key, v int)")
    rows = [(None if v % 3 else 100 * v + (v % 5) * 410, v) for v in range(250_000)]
    base.executemany("insert into t values(?, ?)", rows)
    engine.register("many", spark.range(0, 250_000, 1, 4).toDF("v"))
    engine.sql("insert into t select case when v % 3 then null else 100 * v + (v % 5) * 410 end, v from many order by v")
    query = "select count(*), sum(id), max(id), sum(id * (v % 97)) from t"
    assert tuple(engine.sql(query).first()) == base.execute(query).fetchone()
