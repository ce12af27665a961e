"""Slow, general and binary log texts and raw statement files as event tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import text
from fleetlens.operators import ordered
from fleetlens.sources.records import present, read_records

# --- Fixed values: separators and line forms of the logs. -----------------------------
RECORD_SEPARATOR = ";\n#"
ADMIN_MARK = " administrator command:"
STATEMENT_SEPARATOR = ";\n"
TIME_LINE = r"(?m)^# Time: ([0-9: ]{15})"
USER_LINE = r"# User@Host: ([^\[]+|\[[^\[]+\]).*?@ (\S*) \[(.*)\]"
FILE_HEADER = (
    r"(?m)^(?:T[cC][pP]\s[pP]ort:\s+\d+|[/A-Z].*mysqld,\sVersion.*(?:started\swith:|embedded\slibrary)"
    r"|Time\s+Id\s+Command).*\n"
)
#: Each server header holds one of these, so that texts without them need no search for one.
FILE_HEADER_PARTS = ("port:", "Port:", "mysqld,", "Command")
ENTRY_HEADER = r"(?s)\A((?:(?:#|use |SET (?:last_insert_id|insert_id|timestamp))[^\n]*(?:\n|\z))*+)"
ATTRIBUTE_LINE = r"(?md)^# (?!Time:) *[A-Z][A-Za-z_]+: \S[^\n]*"
ATTRIBUTE = r"\w++:\s+(?:\S+|\Z)"
SETTING = r"([^\s,=]+)\s*=\s*([^,]*)"
BLANKS = " \t\n\x0b\f\r"
ADMIN_LINE = r"(?m)^(# administrator command:.*)$"
GENERAL_FORM = r"(?:\d{6}\s\d{1,2}:\d\d:\d\d)?\s+\d+\s\w+\s+"
GENERAL_LINE = r"(?s)\A(\d{6}\s\d{1,2}:\d\d:\d\d)?\s+(\d+)\s(\w+)[^\S\n]+(.*)\z"
BINLOG_HEADER = (
    r"(?m)^#(\d{6}\s+\d{1,2}:\d\d:\d\d)\s+server\s+id\s+(\d+)\s+end_log_pos\s+(\d+)\s+(\S+)[^\S\n]*([^\n]*)$"
)
BINLOG_QUERY = r"thread_id=(\d+)\s+exec_time=(\d+)\s+error_code=(\d+)"
BINLOG_PREAMBLE = r"(?i)\A((?:(?:#|\s*at \d+|use |SET|DELIMITER|/\*.+\*/;|\s*End of log file)[^\n]*(?:\n|\z))*+)"
SLOW_LOG_COLUMNS = ("Query_time", "Lock_time", "Rows_sent", "Rows_examined", "Thread_id")
YES_NO_COLUMNS = ("QC_Hit", "Full_scan", "Full_join", "Tmp_table", "Disk_tmp_table", "Filesort", "Disk_filesort")
STATEMENT_VERBS = (
    "SELECT", "INSERT", "UPDATE", "DELETE", "REPLACE", "CREATE", "ALTER", "DROP", "TRUNCATE",
    "SET", "CALL", "LOAD", "RENAME", "USE", "SHOW", "COMMIT", "ROLLBACK", "START", "BEGIN",
)
# ----------------------------------------------------------------------------------------


def read_slow_log(spark: SparkSession, path, embed: str | None = None, capture: str | None = None) -> DataFrame:
    return parse_slow_log(read_records(spark, path, RECORD_SEPARATOR, unless=ADMIN_MARK), embed, capture)


def parse_slow_log(records: DataFrame, embed: str | None = None, capture: str | None = None) -> DataFrame:
    """Events of slow-log records ``(file, pos, value)``.

    Records end before a line that opens an entry; administrator commands stay with
    what they follow and are told apart here, so an entry never lies in two records.
    ``(file, pos, part)`` names an event. Common attributes are columns; all
    ``Key: value`` and ``SET`` pairs, and those embedded in the statement, are in ``attrs``.
    """
    # Dropping a server header can join two records, so they are cut again.
    value = F.col("value")
    headers = reduce(or_, (value.contains(p) for p in FILE_HEADER_PARTS))
    bare = F.when(headers, F.regexp_replace("value", FILE_HEADER, "")).otherwise(value)
    several = F.split(F.col("_bare"), RECORD_SEPARATOR + f"(?!{ADMIN_MARK})", -1)
    cut = F.filter(F.when(F.col("_bare").contains(RECORD_SEPARATOR), several).otherwise(F.array("_bare")), lambda t: t.rlike(r"[^#;\s]"))

    def entries(text: Column) -> Column:
        hashed = F.when(text.startswith("#"), text).otherwise(F.concat(F.lit("#"), text))
        return F.transform(F.array(F.regexp_replace(hashed, r";\n?#?\z", "")), commands)[0]

    def commands(text: Column) -> Column:
        apart = F.transform(F.array(F.split(text, rf";\n(?=#{ADMIN_MARK})", -1)), headed)[0]
        return F.when(text.contains(f";\n#{ADMIN_MARK}"), apart).otherwise(F.array(text))

    def headed(parts: Column) -> Column:
        # A header alone goes with the administrator command after it.
        first = F.get(parts, F.lit(0))
        alone = (F.size(parts) > 1) & (F.regexp_replace(first, ENTRY_HEADER, "") == "") & ~first.rlike(ADMIN_LINE)
        return F.when(alone, F.concat(F.array(F.concat_ws(";\n", first, F.get(parts, F.lit(1)))), F.slice(parts, 3, F.size(parts)))).otherwise(parts)

    x = records.select("file", "pos", bare.alias("_bare")).select("file", "pos", F.posexplode(F.flatten(F.transform(cut, entries))).alias("part", "_text"))
    x = x.withColumn("_head", F.regexp_extract("_text", ENTRY_HEADER, 1)).withColumn("_arg", F.substr(F.col("_text"), F.length("_head") + 1))

    # Each line is looked for once, in columns of their own, and taken apart alone.
    head = F.col("_head")
    x = x.withColumns({
        "_admin": F.when(head.contains(f"#{ADMIN_MARK}"), F.regexp_extract(head, ADMIN_LINE, 1)), "_time": F.regexp_extract(head, TIME_LINE, 1),
        "_account": F.regexp_extract(head, USER_LINE, 0), "_use": F.regexp_extract(head, r"(?m)^use ([^;\n]+)", 1),
    })
    x = x.withColumns({"_user": F.regexp_extract("_account", USER_LINE, 1), "_arg": F.coalesce(present(F.col("_admin")), F.col("_arg"))})
    listed = F.array_join(F.regexp_extract_all(head, F.lit(ATTRIBUTE_LINE), F.lit(0)), "\n")
    setting = F.regexp_extract(head, r"(?m)^SET\s+([^;\n]*)", 1)
    arg, account = F.col("_arg"), F.col("_account")
    pairs = [_attributes(listed), text.pairs_of(setting, SETTING)] + ([text.embedded_pairs(arg, embed, capture)] if embed else [])

    def number(name: str) -> Column:
        found = F.regexp_extract(head, rf"(?m)^# (?:.*?\s)??{name}:\s+(\S+)", 1)
        return F.when(head.contains(f"{name}:"), found).try_cast("double").alias(name)

    out = x.select(
        "file", "pos", "part", F.when(present(F.col("_admin")).isNotNull(), "Admin").otherwise("Query").alias("cmd"),
        present(F.col("_time")).alias("ts"), present(F.col("_user")).alias("user"),
        F.when(account != "", F.regexp_extract(account, USER_LINE, 2)).alias("host"),
        F.when(account != "", F.regexp_extract(account, USER_LINE, 3)).alias("ip"),
        present(F.col("_use")).alias("db"), arg.alias("arg"),
        F.octet_length(arg).alias("bytes"), text.pairs_to_map(*pairs).alias("attrs"),
        # Straight from the header: a query that needs no other attribute never builds the map.
        *[number(c) for c in SLOW_LOG_COLUMNS],
    )
    return out


def _attributes(listed: Column) -> Column:
    """The pairs of attribute lines: each is found whole and cut at its colon, so the lines are gone through once."""
    def build(found: Column) -> Column:
        names = F.transform(found, lambda a: F.substring_index(a, ":", 1))
        return text.last_pairs(names, F.transform(found, lambda a: F.ltrim(F.substr(a, F.instr(a, ":") + 1), F.lit(BLANKS))))

    return F.transform(F.array(F.regexp_extract_all(listed, F.lit(ATTRIBUTE), F.lit(0))), build)[0]


def slow_log_text(events: DataFrame) -> Column:
    """One event in slow-log form; absent columns of ``events`` are left out."""
    have = set(events.columns)

    def get(name: str, default="0") -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in have else F.lit(default)

    def number(name: str, fmt: str, cast: str) -> Column:
        return F.format_string(fmt, get(name).cast("double").cast(cast))

    lines = []
    if "ts" in have:
        lines.append(F.concat(F.lit("# Time: "), F.col("ts").cast("string")))
    if "user" in have:
        host = get("host", "")
        lines.append(F.concat(F.lit("# User@Host: "), F.col("user"), F.lit("["), F.col("user"), F.lit("] @ "), host, F.lit(" []")))
    if {"ip", "port"} <= have:
        lines.append(F.concat(F.lit("# Client: "), F.col("ip"), F.lit(":"), F.col("port").cast("string")))
    if "Thread_id" in have:
        lines.append(F.concat(F.lit("# Thread_id: "), F.col("Thread_id").cast("long").cast("string")))
    lines.append(F.concat(
        F.lit("# Query_time: "), number("Query_time", "%.6f", "double"), F.lit("  Lock_time: "), number("Lock_time", "%.6f", "double"),
        F.lit("  Rows_sent: "), number("Rows_sent", "%d", "long"), F.lit("  Rows_examined: "), number("Rows_examined", "%d", "long"),
    ))
    if "QC_Hit" in have:
        first = [F.concat(F.lit(f"{c}: "), get(c, "No")) for c in YES_NO_COLUMNS[:5]]
        second = [F.concat(F.lit(f"{c}: "), get(c, "No")) for c in YES_NO_COLUMNS[5:]] + [F.concat(F.lit("Merge_passes: "), get("Merge_passes"))]
        lines += [F.concat(F.lit("# "), F.concat_ws("  ", *first)), F.concat(F.lit("# "), F.concat_ws("  ", *second))]
    if "db" in have:
        lines.append(F.concat(F.lit("use "), F.col("db"), F.lit(";")))
    arg = F.when(F.col("arg").rlike(r"\Aadministrator command"), F.concat(F.lit("# "), "arg")).otherwise(F.col("arg"))
    return F.concat(F.concat_ws("\n", *lines, arg), F.lit(";"))


def write_slow_log(events: DataFrame, path: str) -> None:
    events.select(slow_log_text(events)).write.mode("errorifexists").text(path)


def read_general_log(spark: SparkSession, path, more_commands: bool = False, block: int = 64 << 20) -> DataFrame:
    """A record of the reader is a whole statement, begun by a line of the general log's form."""
    entries = read_records(spark, path, form=GENERAL_FORM)
    part = [F.regexp_extract("value", GENERAL_LINE, i) for i in range(1, 5)]
    e = entries.select("file", "pos", present(part[0]).alias("ts"), part[1].alias("Thread_id"), part[2].alias("_cmd"), part[3].alias("_all"))
    return _general_events(e.withColumn("_first", F.substring_index("_all", "\n", 1)), more_commands, block)


def parse_general_log(lines: DataFrame, more_commands: bool = False, block: int = 64 << 20) -> DataFrame:
    """Events of general-log lines ``(file, pos, value)``; continuation lines join their statement."""
    part = [F.regexp_extract("value", GENERAL_LINE, i) for i in range(1, 5)]
    x = lines.withColumns({
        "_new": F.when(F.col("value").rlike(GENERAL_LINE), 1).otherwise(0), "_ts": present(part[0]), "_id": part[1], "_cmd": part[2], "_arg": part[3],
    })
    x = ordered.running_sum(x, {"_event": F.col("_new")}, ["pos"], ordered.id_block("pos", block), ["file"]).filter("_event > 0")
    body = F.when(F.col("_new") == 1, F.col("_arg")).otherwise(F.col("value"))
    # One group is one statement's lines.
    e = x.groupBy("file", "_event").agg(
        F.min("pos").alias("pos"), F.max("_ts").alias("ts"), F.max("_id").alias("Thread_id"), F.max("_cmd").alias("_cmd"),
        F.max(F.when(F.col("_new") == 1, F.col("_arg"))).alias("_first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", body.alias("t")))), lambda p: p["t"]), "\n").alias("_all"),
    )
    return _general_events(e, more_commands, block)


def _general_events(e: DataFrame, more_commands: bool, block: int) -> DataFrame:
    """Events of statements; the current database of a thread comes from its last Connect or Init DB.

    ``more_commands`` also takes Execute as a statement and Change user as a connect.
    """
    statement = ["Query", "Execute"] if more_commands else ["Query"]
    in_file = ordered.id_block("pos", block)
    word = r"(\S+)\s+\S+(?:\s+(\S+))?"
    login = F.col("_cmd") == "Connect"
    if more_commands:
        login = login | ((F.col("_cmd") == "Change") & F.col("_first").rlike(r"\Auser\s"))
    subject = F.regexp_replace("_first", r"\Auser\s+", "") if more_commands else F.col("_first")
    denied = login & F.col("_first").startswith("Access denied")
    connect = login & ~denied
    init = F.col("_cmd") == "Init"
    account = F.regexp_extract(subject, r"\A(\S+)", 1)
    db = F.when(connect, present(F.regexp_extract(subject, word, 2))).when(init, present(F.regexp_extract("_first", r"\ADB\s+(\S+)", 1)))
    e = e.withColumn("_db", F.when(connect | init, F.struct(db.alias("db"))))
    e = ordered.carry_last(e, {"_cur": F.col("_db")}, ["pos"], in_file, ["file", "Thread_id"])
    is_query = F.col("_cmd").isin(*statement)
    name = F.when(denied, F.col("_first")).when(init, "Init DB").otherwise(F.col("_cmd"))
    if more_commands:
        name = F.when(F.col("_cmd") == "Change", "Change user").otherwise(name)
    arg = F.when(is_query, F.col("_all")).otherwise(F.concat(F.lit("administrator command: "), name))
    return e.select(
        "file", "pos", "ts", "Thread_id", F.when(is_query, "Query").otherwise("Admin").alias("cmd"), arg.alias("arg"), F.octet_length(arg).alias("bytes"),
        F.when(is_query, F.col("_cur.db")).otherwise(db).alias("db"),
        F.when(connect, F.split_part(account, F.lit("@"), F.lit(1))).alias("user"),
        F.when(connect, present(F.split_part(account, F.lit("@"), F.lit(2)))).alias("host"), F.lit(0.0).alias("Query_time"),
    )


def read_binlog_text(spark: SparkSession, path, block: int = 64 << 20) -> DataFrame:
    return parse_binlog_text(read_records(spark, path, RECORD_SEPARATOR), block)


def parse_binlog_text(records: DataFrame, block: int = 64 << 20) -> DataFrame:
    """Events of a decoded binary log. The active DELIMITER is carried from record to record."""
    def delimiter(text) -> Column:
        given = F.regexp_extract_all(text, F.lit(r"(?m)^DELIMITER[^\S\n]*(\S*)$"), F.lit(1))
        return F.when(F.size(given) > 0, F.regexp_replace(F.element_at(given, -1), r";\z", ""))

    # In force is what the record sets before its statement, else what came before it.
    x = ordered.carry_last(
        records, {"_delim": delimiter("value")}, ["pos"], ordered.id_block("pos", block), ["file"], include_current=False)
    own = delimiter(F.regexp_extract("value", BINLOG_PREAMBLE, 1))
    mark = F.coalesce(present(F.coalesce(own, F.col("_delim"))), F.lit("\u0000"))
    value = F.regexp_replace("value", r";\n?#?\z", "")
    plain = F.replace(value, mark, F.lit(""))
    x = x.withColumn("_text", plain)
    pre = F.regexp_extract("_text", BINLOG_PREAMBLE, 1)
    x = x.withColumn("_pre", pre).withColumn("_arg", F.substr(F.col("_text"), F.length("_pre") + 1))
    head = [F.regexp_extract("_pre", BINLOG_HEADER, i) for i in range(1, 6)]
    kind, rest = head[3], head[4]
    arg = F.regexp_replace(F.regexp_replace("_arg", r"(?m)^DELIMITER.*$", ""), r"(?m);$", "")
    arg = F.regexp_replace(arg, r"\s+\z", "")
    settings = F.array_join(F.regexp_extract_all("_pre", F.lit(r"(?m)^SET\s+([^;\n]*)"), F.lit(1)), ",")
    known = kind.isin("Query", "Xid", "Start:") | (kind == "")
    out = x.filter(known & (arg != "")).select(
        "file", "pos", F.lit("Query").alias("cmd"), present(F.regexp_extract("_pre", r"(?m)\bat (\d+)$", 1)).alias("offset"),
        present(head[0]).alias("ts"), present(head[1]).alias("server_id"), present(head[2]).alias("end_log_pos"),
        F.when(kind == "Xid", F.regexp_extract(rest, r"(\d+)", 1)).alias("Xid"),
        F.when(kind == "Query", present(F.regexp_extract(rest, BINLOG_QUERY, 1))).alias("Thread_id"),
        F.when(kind == "Query", F.regexp_extract(rest, BINLOG_QUERY, 2).try_cast("double")).alias("Query_time"),
        F.when(kind == "Query", present(F.regexp_extract(rest, BINLOG_QUERY, 3))).alias("error_code"),
        present(F.regexp_extract("_pre", r"(?m)^use ([^;\n]+)", 1)).alias("db"), arg.alias("arg"), F.octet_length(arg).alias("bytes"),
        text.pairs_to_map(text.pairs_of(F.lower(settings), SETTING)).alias("attrs"),
    )
    return out


def read_raw_statements(spark: SparkSession, path, verbs=STATEMENT_VERBS) -> DataFrame:
    return parse_raw_statements(read_records(spark, path, STATEMENT_SEPARATOR), verbs)


def parse_raw_statements(records: DataFrame, verbs=STATEMENT_VERBS, block: int = 64 << 20) -> DataFrame:
    """Statements ending in ``;`` and a line end, those of known verbs, with the database in use."""
    sql = F.regexp_replace(F.regexp_replace("value", r"\A\s+", ""), r";?\s*\z", "")
    x = records.withColumn("sql", sql).withColumn("verb", F.upper(F.regexp_extract("sql", r"\A\(?\s*(\w+)", 1)))
    used = F.when(F.col("verb") == "USE", F.regexp_extract("sql", r"(?i)\Ause\s+`?([^\s`;]+)", 1))
    x = ordered.carry_last(x, {"db": used}, ["pos"], ordered.id_block("pos", block), ["file"])
    return x.filter(F.col("verb").isin(*verbs) & (F.col("verb") != "USE")).select("file", "pos", "db", "verb", "sql")


def split_compound(events: DataFrame, sql: str = "sql", verbs=STATEMENT_VERBS) -> DataFrame:
    """One row per statement of compound entries, known verbs only."""
    parts = events.select(*[c for c in events.columns if c != sql], F.posexplode(F.split(sql, r";\n", -1)).alias("part", "_s"))
    s = F.regexp_replace("_s", r"\A\s+|;?\s*\z", "")
    return parts.withColumn(sql, s).drop("_s").filter(F.upper(F.regexp_extract(sql, r"\A(\w+)", 1)).isin(*verbs))
