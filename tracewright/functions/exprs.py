"""Column expressions on audit values: strings, hex, addresses, paths, commands, colours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright import schema


def fields(line: Column) -> tuple[Column, Column]:
    """Keys of an audit line, and their values as they stand there: quoted or bare, after a space or at the start. A doubled = is one."""
    pair = F.lit(r'(?:^|\s)([^\s="]+)==?("[^"]*"|\S*)')
    return F.regexp_extract_all(line, pair, F.lit(1)), F.regexp_extract_all(line, pair, F.lit(2))


def value_of(keys: Column, values: Column, key: str | Column) -> Column:
    """The first value of a key, as it stands in the line; null if it is missing."""
    at = F.array_position(keys, key)
    return F.when(at > 0, F.get(values, (at - 1).cast("int")))


def unquoted(x: Column) -> Column:
    return F.when(is_quoted(x), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)


def is_quoted(x: Column) -> Column:
    return x.rlike('^"[^"]*"$')


def raw_hex(x: Column) -> Column:
    """Leading hex digits as an unsigned number (a decimal string's worth of up to 64 bits)."""
    return F.conv(F.regexp_extract(x, "^[0-9A-Fa-f]*", 0), 16, 10)


def hex_text(x: Column, quoted: Column) -> Column:
    """Decodes an unquoted string of hex pairs; line feeds, tabs and such are escaped."""
    names = {0: "\\0", 9: "\\t", 10: "\\n", 13: "\\r"}

    def shown(pair: Column) -> Column:
        code = F.conv(pair, 16, 10).cast("int")
        out = reduce(lambda acc, kv: acc.when(code == kv[0], F.lit(kv[1])), list(names.items())[1:], F.when(code == 0, F.lit(names[0])))
        return out.when(code.between(32, 126), F.char(code)).otherwise(F.concat(F.lit("\\x"), F.lower(pair)))

    pairs = F.transform(F.regexp_extract_all(x, F.lit("(..)"), F.lit(1)), shown)
    return F.when(~quoted & x.rlike("^([0-9A-Fa-f]{2})+$"), F.array_join(pairs, "")).otherwise(x)


def decode_comm(comm: Column) -> Column:
    """A command name in hex (over 8 digits) as text if that is printable ASCII; else as it is."""
    even = F.substring(comm, F.lit(1), F.length(comm) - F.length(comm) % 2)
    text = F.decode(F.unhex(even), "UTF-8")
    return F.when(comm.rlike("^[0-9A-Fa-f]{9,}$"), F.when(text.rlike(r"^[\x20-\x7e]+$"), text).otherwise(comm)).otherwise(comm)


def strip_overlay(path: Column) -> Column:
    """Path within a container: what follows /merged, else /fs, else /rootfs/overlayfs/<id>."""
    out = F.when(F.instr(path, "/merged/") > 0, F.regexp_extract(path, "^.*?/merged(/.*)$", 1))
    out = out.when(F.instr(path, "/fs/") > 0, F.regexp_extract(path, "^.*?/fs(/.*)$", 1))
    return out.when(path.rlike("/rootfs/overlayfs/[^/]+/"), F.regexp_extract(path, "^.*?/rootfs/overlayfs/[^/]+(/.*)$", 1)).otherwise(path)


def canonical_path(path: Column) -> Column:
    """Path without empty, . and .. segments; never above the root. A leading ./ goes; relative paths stay relative."""
    absolute = F.startswith(path, F.lit("/"))

    def step(acc: Column, part: Column) -> Column:
        up = F.when((F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)).when(absolute, acc).otherwise(F.array_append(acc, part))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.array_append(acc, part))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(parts, "/"))


def ipv6_text(h: Column) -> Column:
    """32 hex digits as an IPv6 address, the longest run of zero groups (of two or more, the first such) shortened."""
    groups = [F.lower(F.regexp_replace(F.substring(h, 4 * i + 1, 4), "^0{1,3}", "")) for i in range(8)]
    full = F.concat_ws(":", *groups)
    out = None
    for n in range(8, 1, -1):
        run = ":".join("0" * n)
        pattern = rf"(^|:){run}(:|$)"
        short = F.regexp_replace(full, rf"^(.*?)(?:^|:){run}(?::|$)(.*)$", "$1::$2")
        out = F.when(full.rlike(pattern), short) if out is None else out.when(full.rlike(pattern), short)
    return out.otherwise(full)


def decode_sockaddr(saddr: Column) -> Column:
    """kind, ip, port, path, raw, display of a socket address in hex; null for less than two bytes."""
    h = F.regexp_extract(saddr, "^[0-9A-Fa-f]*", 0)
    n = F.floor(F.length(h) / 2)
    byte = lambda i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int")
    family = byte(0) + byte(1) * 256
    port = byte(2) * 256 + byte(3)
    v4 = lambda at: F.concat_ws(".", *[byte(at + i) for i in range(4)])
    v6 = F.rpad(F.substring(h, 17, 32), 32, "0")
    mapped = F.lower(F.substring(v6, 1, 24)) == "00000000000000000000ffff"
    v6_as_v4 = F.concat_ws(".", *[F.conv(F.substring(v6, 25 + 2 * i, 2), 16, 10) for i in range(4)])
    body = F.substring(h, F.lit(5), F.length(h))
    text = lambda x: F.decode(F.unhex(x), "UTF-8")
    upto = F.regexp_extract(body, "^((?:(?!00)..)*)", 1)
    unix = F.when(F.startswith(body, F.lit("00")), F.concat(F.lit("@"), F.regexp_replace(text(F.substring(body, F.lit(3), F.length(body))), "\\x00+$", ""))).otherwise(text(upto))
    proto = F.when(n >= 8, byte(4) + byte(5) * 256 + byte(6) * 65536 + byte(7) * 16777216).otherwise(F.lit(0))
    names = F.create_map(*[x for k, v in schema.NETLINK.items() for x in (F.lit(k), F.lit(v))])
    raw = F.when(family == 16, F.concat(F.lit("netlink:"), F.coalesce(F.try_element_at(names, proto), F.lit("unknown")))).when(family == 17, "packet:raw").otherwise(F.concat(F.lit("af"), family))
    inet, inet6, local = (family == 2) & (n >= 8), (family == 10) & (n >= 8), (family == 1) & (n > 2)
    kind = F.when(inet | inet6 & mapped, "inet").when(inet6, "inet6").when(local, "unix").otherwise("other")
    ip = F.when(inet, v4(4)).when(inet6 & mapped, v6_as_v4).when(inet6, ipv6_text(v6))
    shown = F.when(inet | inet6 & mapped, F.concat_ws(":", ip, port)).when(inet6, F.concat(F.lit("["), ip, F.lit("]:"), port)).when(local, F.concat(F.lit("unix:"), unix)).otherwise(raw)
    whole = F.struct(kind.alias("kind"), ip.alias("ip"), F.when(inet | inet6, port).alias("port"), F.when(local, unix).alias("path"), F.when(kind == "other", raw).alias("raw"), shown.alias("display"))
    return F.when(n >= 2, whole)


def is_write(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(schema.WRITE_FLAGS)) != 0


def normal_command(cmd: Column) -> Column:
    """Command with tokens that look like generated names or addresses replaced, so that repeats are alike."""

    def shown(token: Column) -> Column:
        name = F.element_at(F.split(token, "/"), -1)
        base = F.element_at(F.split(name, r"\."), 1)
        classes = sum((base.rlike(c).cast("int") for c in ("[A-Z]", "[a-z]", "[0-9]")), F.lit(0))
        temp = ~F.startswith(name, F.lit("-")) & (name != "") & (F.length(base) >= 6)
        temp = temp & (((classes >= 3) & F.contains(token, F.lit("/tmp/"))) | (F.startswith(base, F.lit("cc")) & (classes >= 2) & (F.length(base) >= 8)))
        return F.when(temp, "<TMP>").when(is_address_token(token), "<ADDR>").otherwise(token)

    return F.array_join(F.transform(F.split(cmd, " "), shown), " ")


def is_address_token(token: Column) -> Column:
    octet = r"\+?0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return token.rlike(rf"^https?://|^{octet}(\.{octet}){{3}}(:|$)")


def glob_match(path: Column, pattern: Column) -> Column:
    """Whether path fits pattern: * alone, *suffix, prefix*, or else a prefix; other stars are literal."""
    rest = F.substring(pattern, F.lit(2), F.length(pattern))
    head = F.substring(pattern, F.lit(1), F.length(pattern) - 1)
    return F.when(pattern == "*", True).when(F.startswith(pattern, F.lit("*")), F.endswith(path, rest)).when(F.endswith(pattern, F.lit("*")), F.startswith(path, head)).otherwise(F.startswith(path, pattern))


def full_glob_match(path: Column, pattern: Column) -> Column:
    """Whether the whole path fits a glob: * is any run of letters, ? any one; a pattern without them fits what is below it as well."""
    like = F.regexp_replace(pattern, r"([\\%_])", r"\\$1")
    like = F.translate(like, "*?", "%_")
    return F.when(pattern.rlike(r"[*?]"), F.like(path, like)).otherwise((path == pattern) | F.startswith(path, F.concat(pattern, F.lit("/"))))


def pattern_key(kind: str, n: Column, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("n"), key.alias("key"))


def ends_key(pattern: Column) -> Column:
    """What a path that fits a pattern of glob_match begins or ends with: (kind, n, key)."""
    n = F.length(pattern)
    first, last = pattern_key("prefix", n - 1, F.left(pattern, n - 1)), pattern_key("suffix", n - 1, F.right(pattern, n - 1))
    return F.when(pattern == "*", pattern_key("any", F.lit(0), F.lit(""))).when(F.startswith(pattern, F.lit("*")), last).when(F.endswith(pattern, F.lit("*")), first).otherwise(pattern_key("prefix", n, pattern))


def glob_key(pattern: Column) -> Column:
    """What a path that fits a glob must have: (kind, n, key); its first or last letters, a whole folder, or three letters in a row."""
    pieces = F.split(pattern, r"[*?]")
    first, last = F.get(pieces, 0), F.element_at(pieces, -1)
    longest = F.array_max(F.transform(pieces, lambda x: F.struct(F.length(x).alias("n"), x.alias("piece"))))["piece"]
    folder = F.regexp_extract(longest, "/([^/]+)/", 1)
    ends = F.when(F.size(pieces) == 1, pattern_key("prefix", F.length(pattern), pattern)).when((first != "") & (F.length(first) >= F.length(last)), pattern_key("prefix", F.length(first), first))
    ends = ends.when(last != "", pattern_key("suffix", F.length(last), last)).when(folder != "", pattern_key("folder", F.lit(0), folder))
    return ends.when(F.length(longest) >= 3, pattern_key("gram", F.lit(3), F.left(longest, F.lit(3)))).otherwise(pattern_key("any", F.lit(0), F.lit("")))


def path_keys(path: Column, lengths: set[tuple[str, int]]) -> Column:
    """All that patterns of such kinds and lengths can ask of a path: an array of (kind, n, key)."""
    out = []
    for kind, n in sorted(lengths):
        key = {"prefix": F.left(path, F.lit(n)), "suffix": F.right(path, F.lit(n)), "any": F.lit("")}.get(kind)
        if key is not None:
            out.append(F.array(pattern_key(kind, F.lit(n), key)))
        elif kind == "folder":
            out.append(F.transform(F.split(path, "/"), lambda x: pattern_key("folder", F.lit(0), x)))
        else:
            out.append(F.transform(F.sequence(F.lit(1), F.greatest(F.length(path) - 2, F.lit(1))), lambda i: pattern_key("gram", F.lit(3), F.substring(path, i, F.lit(3)))))
    return F.concat(*out) if out else F.array().cast("array<struct<kind:string,n:int,key:string>>")


def is_endpoint(addr: Column) -> Column:
    """Addresses that name an endpoint: all but wildcards."""
    return ~F.startswith(addr, F.lit("0.0.0.0:")) & ~F.startswith(addr, F.lit("[::]:"))


def is_local_address(addr: Column) -> Column:
    return addr.rlike(r"^(127\.|0\.0\.0\.0|\[::1\]|\[::\]|unix:|netlink:|packet:)")


def address_ip(addr: Column) -> Column:
    """IPv4 part of ip:port; null for anything else."""
    return F.nullif(F.regexp_extract(addr, r"^(\d+\.\d+\.\d+\.\d+):\d+$", 1), F.lit(""))


def truncated(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n - 3)), F.lit("..."))).otherwise(x)


def starts(path: Column, prefixes: str) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(path, F.lit(p)) for p in prefixes.split()])


def has(path: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(path, F.lit(p)) for p in parts])


def is_record_noise(path: Column) -> Column:
    """Paths that never name a file of interest in a PATH record."""
    return path.isNull() | path.isin("", "(null)", ".", "/") | F.startswith(path, F.lit("/proc/"))


def is_flow_noise(path: Column) -> Column:
    """Paths that make no file-flow edges."""
    return starts(path, "/proc/ /dev/ /sys/ /usr/lib/ /lib/ /usr/include/ /usr/share/ /etc/apk/ /etc/terminfo/") | F.contains(path, F.lit(".so"))


def is_receipt_noise(path: Column) -> Column:
    """Paths that receipts leave out."""
    out = path.isin("", "/", "/runc") | starts(path, "/proc/ /dev/ /sys/ /bin/ /sbin/ /usr/bin/ /usr/sbin/ /usr/lib/ /lib/ // socket: pipe: anon_inode:")
    out = out | has(path, [".so", "ld-musl", "ld-linux", "__pycache__", "(null)"]) | F.endswith(path, F.lit(".pyc"))
    return out | path.rlike(r"^/[0-9]|^[0-9]*$|^[0-9A-Fa-f]{12,}$") | ~F.contains(path, F.lit("/")) & ~F.startswith(path, F.lit("."))


def is_graph_noise(path: Column) -> Column:
    """Paths that graphs leave out."""
    out = path.isin("", "/") | starts(path, "/proc/ /dev/ /sys/ pipe: anon_inode: socket: //") | has(path, ["(deleted)", "(null)", "/overlay2/", "/docker/"])
    return out | path.rlike(r"^[0-9]*$|^[0-9A-Fa-f]{12,}$|(^|/)[0-9A-Fa-f]{20,}(/|$)") | ~F.contains(path, F.lit("/")) & ~F.startswith(path, F.lit("."))


def is_baseline_sensitive(path: Column) -> Column:
    tests = []
    for p in schema.BASELINE_SENSITIVE:
        head, star, tail = p.partition("*")
        tests.append(F.startswith(path, F.lit(head)) & F.endswith(path, F.lit(tail)) if star else F.startswith(path, F.lit(p)))
    return reduce(lambda a, b: a | b, tests)


def is_receipt_sensitive(path: Column) -> Column:
    return has(path, schema.RECEIPT_SENSITIVE)


def is_graph_sensitive(path: Column) -> Column:
    return has(path, schema.GRAPH_SENSITIVE)


def is_runtime(exe: Column, comm: Column) -> Column:
    base = F.element_at(F.split(F.coalesce(exe, F.lit("")), "/"), -1)
    return base.isin("runc", "containerd-shim") | (comm == "runc") | F.startswith(comm, F.lit("runc:"))


def process_label(comm: Column, pid: Column) -> Column:
    return F.concat(F.coalesce(comm, F.lit("?")), F.lit(":"), pid)


def severity_mark(severity: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in (" ", ".", "!", "!!")]), severity + 1)


def short_path(path: Column) -> Column:
    return F.right(path, F.lit(45))


def action_colour(action: Column, which: int = 0) -> Column:
    """Fill (0) or border (1) colour of an action."""
    palette = F.array(*[F.lit(c[which]) for c in schema.ACTION_COLOURS])
    return F.when(action == 0, schema.BASELINE_COLOUR[which]).otherwise(F.element_at(palette, ((action - 1) % len(schema.ACTION_COLOURS) + 1).cast("int")))


def blended(colour: Column, score: Column) -> Column:
    """Colour drawn towards grey (232) by 1 - score."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    part = lambda i: F.lpad(F.lower(F.hex((F.lit(232.0) + (F.conv(F.substring(colour, i, 2), 16, 10).cast("int") - 232) * s).cast("int"))), 2, "0")
    return F.concat(F.lit("#"), part(2), part(4), part(6))


def edge_colour(score: Column) -> Column:
    """Red, the paler the lower the source's score; grey below the limit of taint."""
    pale = F.lpad(F.lower(F.hex(F.lit(255) - F.least(F.lit(255), F.floor(score * 255)).cast("int"))), 2, "0")
    return F.when(score >= schema.TAINTED, F.concat(F.lit("#cc"), pale, pale)).otherwise("#cccccc")


def path_id(path: Column) -> Column:
    """A number that stands for a path in a graph; equal paths have equal ones."""
    return F.xxhash64(path)


def escaped(x: Column, form: str = "dot") -> Column:
    """Text inside a quoted string of a DOT file, or inside HTML."""
    pairs = {"dot": [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")], "html": [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]}[form]
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), pairs, x)
