"""Parsing of audit records: one or more of each type, made up here."""

from pyspark.sql import functions as F

from tracewright.functions import exprs as X
from tracewright.operators import enrich
from tracewright.sources import records

CALL = 'audit(1712000555.042:77120): arch=c000003e syscall=2 success=yes exit=9 a0=55d0c8e3b2a0 a1=241 a2=1b6 a3=0 items=2 ppid=4100 pid=4177 comm="rsync" exe="/opt/bin/rsync" subj=docker-default key="watch"'


def parsed(spark, *rows):
    return records.parse(spark.createDataFrame(list(rows), "rec_type string, line string")).collect()


def test_syscall(spark):
    (r,) = parsed(spark, ("SYSCALL", CALL))
    assert (r.serial, r.ts_ms, r.pid, r.ppid, r.syscall, r.success, r.exit_value, r.comm, r.exe, r.subj) == (77120, 1712000555042, 4177, 4100, 2, True, 9, "rsync", "/opt/bin/rsync", "docker-default")
    assert int(r.a0) == 0x55D0C8E3B2A0 and int(r.a1) == 0x241


def test_missing_numbers_and_double_equals(spark):
    (r,) = parsed(spark, ("SYSCALL", "audit(42:9): pid=6 subj==kernel_t syscall=3"))
    assert (r.subj, r.exit_value, r.success, r.ts_ms, r.serial, r.ppid) == ("kernel_t", -1, False, 42000, 9, 0)


def test_keys_inside_quoted_values(spark):
    (r,) = parsed(spark, ("SYSCALL", 'audit(42.5:9): comm="a pid=7" pid=6 ppid=2 apid=3'))
    assert (r.comm, r.pid, r.ppid) == ("a pid=7", 6, 2)


def test_raw_hex(spark):
    (r,) = parsed(spark, ("SYSCALL", "audit(7:8): a0=1f a1=400 a2=0 a3=CAFE"))
    assert [int(x) for x in (r.a0, r.a1, r.a2, r.a3)] == [31, 1024, 0, 51966]


def test_paths(spark):
    a, b, c = parsed(spark, ("PATH", 'audit(5.001:6): item=1 name="/srv/keys/ring.bin" inode=77 nametype=CREATE'), ("PATH", 'audit(5.001:6): item=0 name="/srv/keys" nametype=PARENT'), ("PATH", "audit(5.001:6): item=2 name=2F7372762F6120622E747874 nametype=NORMAL"))
    assert (a.item, a.name, a.nametype, b.nametype, c.name) == (1, "/srv/keys/ring.bin", "CREATE", "PARENT", "/srv/a b.txt")


def test_sockaddr_cwd_and_execve(spark):
    rows = [
        ("SOCKADDR", "audit(3:4): saddr=02001F90C0A807210000000000000000SADDR={ saddr_fam=inet }"), ("EXECVE", 'audit(3:4): argc=3 a0="tar" a1="-czf" a2="/srv/out.tgz"'), ("EXECVE", 'audit(3:4): argc=2 a0="awk" a1=7072696E740A2431'),
        ("CWD", 'audit(3:4): cwd="/srv/work"'), ("CWD", "audit(3:4): cwd=2F73727620776F726B"),
    ]
    a, b, c, d, e = parsed(spark, *rows)
    assert a.saddr == "02001F90C0A807210000000000000000"
    assert b.argv == ["tar", "-czf", "/srv/out.tgz"]
    assert c.argv == ["awk", "print\\n$1"]
    assert (d.cwd, e.cwd) == ("/srv/work", "/srv work")


def test_addresses(spark):
    cases = {
        "02001F90C0A807210000000000000000": "192.168.7.33:8080", "0A00005000000000" + "00" * 15 + "01": "[::1]:80", "0A000050": "af10", "0A00005000000000": "[::]:80",
        "0A0001BB00000000" + "00" * 10 + "FFFFAC100A05": "172.16.10.5:443", "01002F7372762F7300": "unix:/srv/s", "0100007879": "unix:@xy", "100000000C000000": "netlink:netfilter", "1100": "packet:raw", "0800": "af8", "02": None,
    }
    df = spark.createDataFrame(list(cases.items()), "h string, want string").select("want", X.decode_sockaddr(F.col("h"))["display"].alias("got"))
    assert [(r.want, r.got) for r in df.collect() if r.want != r.got] == []


def test_paths_and_commands(spark):
    paths = {"/u/./v//w": "/u/v/w", "/../y": "/y", "./u/../v": "v", "/u/../../..": "/", "u/v/": "u/v", "": ""}
    df = spark.createDataFrame(list(paths.items()), "p string, want string").select("want", X.canonical_path(F.col("p")).alias("got"))
    assert [tuple(r) for r in df.collect() if r.want != r.got] == []
    commands = {"as /tmp/ccQ8rTz1.s": "as <TMP>", "wget http://h.i/j 9.8.7.6:443 9.8.7": "wget <ADDR> <ADDR> 9.8.7", "du -sh": "du -sh"}
    df = spark.createDataFrame(list(commands.items()), "c string, want string").select("want", X.normal_command(F.col("c")).alias("got"))
    assert [tuple(r) for r in df.collect() if r.want != r.got] == []


def test_assembly(spark):
    end = ("EOE", "audit(1712000555.042:77120): ")
    path = ("PATH", 'audit(1712000555.042:77120): item=1 name="/srv/out" nametype=CREATE')
    parent = ("PATH", 'audit(1712000555.042:77120): item=0 name="/srv" nametype=PARENT')
    stray = ("PATH", 'audit(9.0:77121): item=0 name="/gone" nametype=NORMAL')
    rows = records.parse(spark.createDataFrame([("SYSCALL", CALL), end, path, parent, stray], "rec_type string, line string"))
    (r,) = records.classify(records.assemble(rows), enrich.syscall_table(spark)).collect()
    # the path that isn't the parent's
    assert (r.serial, r.syscall_name, r.path, r.flags, r.ret) == (77120, "open", "/srv/out", 0x241, 9)
    assert records.assemble(rows, "other").count() == 0
