"""Privilege rows: flag columns, sets, level bitmaps and GRANT text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: flag columns, level bits and what ALL means at each level. ----
FLAGS = (
    "Create_priv", "Drop_priv", "Grant_priv", "References_priv", "Event_priv",
    "Alter_priv", "Delete_priv", "Index_priv", "Insert_priv", "Select_priv",
    "Update_priv", "Create_tmp_table_priv", "Lock_tables_priv", "Trigger_priv",
    "Create_view_priv", "Show_view_priv", "Alter_routine_priv",
    "Create_routine_priv", "Execute_priv", "File_priv", "Create_user_priv",
    "Process_priv", "Reload_priv", "Repl_client_priv", "Repl_slave_priv",
    "Show_db_priv", "Shutdown_priv", "Super_priv",
)
DELETED, UNREACHABLE = 1 << 1, 1 << 2
LEVEL_BITS = {
    "global": 1 << 4, "host": 1 << 5, "db": 1 << 6,
    "table": 1 << 7, "column": 1 << 8, "proc": 1 << 9,
}
ALL_DB = (
    "Select_priv", "Insert_priv", "Update_priv", "Delete_priv", "Create_priv",
    "Drop_priv", "References_priv", "Index_priv", "Alter_priv",
    "Create_tmp_table_priv", "Lock_tables_priv", "Create_view_priv",
    "Show_view_priv", "Create_routine_priv", "Execute_priv", "Event_priv",
    "Trigger_priv",
)
ALL_TABLE = (
    "Select_priv", "Insert_priv", "Update_priv", "Delete_priv", "Create_priv",
    "Drop_priv", "References_priv", "Index_priv", "Alter_priv",
    "Create_view_priv", "Show_view_priv", "Trigger_priv",
)
ALL_COLUMN = ("Select_priv", "Insert_priv", "Update_priv", "References_priv")
ALL_PROC = ("Execute_priv", "Alter_routine_priv")
# -----------------------------------------------------------------------------------

ALL_AT = {
    "global": tuple(f for f in FLAGS if f != "Grant_priv"),
    "host": ALL_DB,
    "db": ALL_DB,
    "table": ALL_TABLE,
    "column": ALL_COLUMN,
    "proc": ALL_PROC,
}
LEVEL_KEYS = {
    "global": ("Host", "User"),
    "host": ("Host", "Db"),
    "db": ("Host", "Db", "User"),
    "table": ("Host", "Db", "User", "Table_name"),
    "column": ("Host", "Db", "User", "Table_name", "Column_name"),
    "proc": ("Host", "Db", "User", "Routine_name", "Routine_type"),
}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def flags_from_text(text) -> Column:
    """``Select,Show view`` to the sorted array of flag column names; an unknown name fails the job."""
    known = F.array(*map(F.lit, FLAGS))

    def flag(p: Column) -> Column:
        name = F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.replace(F.substr(p, F.lit(2)), F.lit(" "), F.lit("_"))), F.lit("_priv"))
        unknown = F.raise_error(F.concat(F.lit("unknown privilege: "), p)).cast("string")
        return F.when((p == "") | F.array_contains(known, name), name).otherwise(unknown)

    return F.array_sort(F.transform(F.split(_c(text), ","), flag))


def flags_from_row(flags=FLAGS) -> Column:
    """Names of the flag columns holding ``Y``, as a sorted array."""
    return F.array_sort(
        F.array_compact(F.array(*[F.when(F.col(f) == "Y", F.lit(f)) for f in flags]))
    )


def has_bit(permtype, bit: int) -> Column:
    return _c(permtype).bitwiseAND(F.lit(bit)) != 0


def level_of(permtype) -> Column:
    out = F.lit(None).cast("string")
    for level, bit in LEVEL_BITS.items():
        out = F.when(has_bit(permtype, bit), F.lit(level)).otherwise(out)
    return out


def privilege_word(flag: Column) -> Column:
    text = F.upper(F.replace(flag, F.lit("_"), F.lit(" ")))
    text = F.replace(text, F.lit(" PRIV"), F.lit(""))
    text = F.regexp_replace(text, r"\bREPL\b", "REPLICATION")
    return F.replace(text, F.lit("TMP TABLE"), F.lit("TEMPORARY TABLES"))


def covers(flags, required) -> Column:
    """True when ``flags`` holds every name of ``required``."""
    wanted = F.array(*[F.lit(f) for f in required]) if not isinstance(required, Column) else required
    return F.size(F.array_except(wanted, _c(flags))) == 0


def privilege_list(flags, level) -> Column:
    """``ALL PRIVILEGES``, ``USAGE`` or the listed privileges of a set at a level."""
    flags = F.array_remove(_c(flags), "Grant_priv")
    everything = F.lit(False)
    for name, required in ALL_AT.items():
        everything = F.when(_c(level) == name, covers(flags, required)).otherwise(everything)
    return (
        F.when(everything, F.lit("ALL PRIVILEGES"))
        .when(F.size(flags) == 0, F.lit("USAGE"))
        .otherwise(F.array_join(F.transform(flags, privilege_word), ", "))
    )


def grant_text(flags, permtype, user="User", host="Host", db="Db", table="Table_name",
               column="Column_name", password=None) -> Column:
    """The statement that restores a privilege row."""
    level = level_of(permtype)
    flags = _c(flags)
    host_name = F.when(F.coalesce(_c(host), F.lit("")) == "", F.lit("%")).otherwise(_c(host))
    who = F.concat(F.lit("'"), _c(user), F.lit("'@'"), host_name, F.lit("'"))
    on = (
        F.when(level == "db", F.concat(F.lit("ON `"), _c(db), F.lit("`.*")))
        .when(
            level.isin("table", "column"),
            F.concat(F.lit("ON `"), _c(db), F.lit("`.`"), _c(table), F.lit("`")),
        )
        .otherwise(F.lit("ON *.*"))
    )
    listed = privilege_list(flags, level)
    listed = F.when(
        (level == "column") & (listed != "USAGE"),
        F.array_join(
            F.transform(F.split(listed, ", "), lambda p: F.concat(p, F.lit(" ("), _c(column), F.lit(")"))),
            ", ",
        ),
    ).otherwise(listed)
    pw = F.lit(None).cast("string") if password is None else F.when(
        _c(password) != "", F.concat(F.lit("IDENTIFIED BY PASSWORD '"), _c(password), F.lit("'"))
    )
    grant = F.when(F.array_contains(flags, "Grant_priv"), F.lit("WITH GRANT OPTION"))
    text = F.concat_ws(" ", F.lit("GRANT"), listed, on, F.lit("TO"), who, pw, grant)
    dropped = F.concat(F.lit("DROP USER "), who)
    names = F.filter(flags, lambda f: f != "Grant_priv")
    host_row = F.when(
        has_bit(permtype, DELETED),
        F.concat(F.lit("DELETE FROM `mysql`.`host` WHERE Host='"), _c(host), F.lit("' AND Db='"), _c(db), F.lit("'")),
    ).otherwise(
        F.concat(
            F.lit("REPLACE INTO `mysql`.`host` ("),
            F.array_join(F.concat(F.array(F.lit("Host"), F.lit("Db")), names), ","),
            F.lit(") VALUES ('"), _c(host), F.lit("','"), _c(db), F.lit("'"),
            F.array_join(F.transform(names, lambda f: F.lit(",'Y'")), ""),
            F.lit(")"),
        )
    )
    return (
        F.when(level == "host", host_row)
        .when(has_bit(permtype, DELETED), dropped)
        .otherwise(text)
    )
