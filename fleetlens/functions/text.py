"""Statement text as column expressions.

Everything here is a pure ``Column -> Column`` rewrite, so a whole log table is
normalised inside one projection, next to the scan, without any Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: the patterns and words that define a statement class. -----
ONE_LINE_COMMENT = r"""(?:--|#)[^'"\r\n]*(?=[\r\n]|\z)"""
MULTI_LINE_COMMENT = r"(?s)/\*[^!].*?\*/"
DUMP_PREFIX = "SELECT /*!40001 SQL_NO_CACHE */ * FROM `"
CHECKSUM_MARK = r"/\*\w+\.\w+:[0-9]/[0-9]\*/"
CHECKSUM_WORD = "maatkit"
ADMIN_PREFIX = "# administrator command: "
CALL = r"(?i)\A\s*(call\s+\S+)\("
MULTI_ROW_INSERT = (
    r"(?is)\A((?:INSERT|REPLACE)(?: IGNORE)?\s+INTO.+?VALUES\s*\(.*?\))\s*,\s*\("
)
USE_DB = r"(?i)\Ause \S+(?=\n?\z)"
NUMBER_LIKE = r"[0-9+-][0-9a-f.xb+-]*"
NUMBER_LEFTOVER = r"[xb.+-]\?"
VALUE_LIST = r"\b(in|values?)(?:[\s,]*+\([\s?,]*+\))++"
REPEATED_UNION = r"\b(select\s.*?)(?:(\sunion(?:\sall)?)\s\1)+"
LIMIT_CLAUSE = r"(?s)\A(.*?)\blimit \?(?:, ?\?| offset \?)?"
VERB = (
    r"(?i)\b(^SHOW|^FLUSH|^COMMIT|^ROLLBACK|^BEGIN|SELECT|INSERT|UPDATE|DELETE"
    r"|REPLACE|^SET|UNION|^START|^LOCK)\b"
)
SHOWN = r"(?i)SHOW\s+(\S+)(?:\s+(\S+))?"
CALLED = r"(?i)\A\s*call\s+(\S+)\("
XA = r"(?i)\A\s*xa\s+(\S+)"
DDL_VERB = r"(?:CREATE|ALTER|TRUNCATE|DROP|RENAME)"
DML_VERB = r"(?:INSERT|UPDATE|DELETE|REPLACE)"
IDENT = r"(?:`[^`]+`|\w+)(?:\.(?:`[^`]+`|\w+))?"
TABLE_LIST = (
    r"(?i)\b(?:FROM|JOIN|(?<!KEY\s)UPDATE|INTO)\b\s*"
    rf"({IDENT}(?:(?:\s+(?:AS\s+)?\w+)?,\s*{IDENT})*)"
)
DERIVED_TABLE = r"(?i)\b(?:FROM|JOIN|,)\s*\(\s*SELECT"
SPLIT_VERB = r"(?:SELECT|INSERT|UPDATE|DELETE|REPLACE|UNION|CREATE)"
KEY_PART = r"[0-9A-Fa-f]{16,}|\d+"
KEY_VALUE_COMMANDS = (
    "set", "add", "replace", "append", "prepend", "cas",
    "get", "gets", "delete", "incr", "decr",
)
STORAGE_COMMANDS = ("set", "add", "replace", "append", "prepend", "cas")
RETRIEVAL_COMMANDS = ("get", "gets")
IN_LIST_KEEP = 20
# ------------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_quoted(sql) -> Column:
    """Drop escaped quotes, then fold every quoted string to ``?``."""
    sql = F.regexp_replace(_c(sql), r"""\\["']""", "")
    sql = F.regexp_replace(sql, r'(?s)".*?"', "?")
    return F.regexp_replace(sql, r"(?s)'.*?'", "?")


def strip_comments(sql) -> Column:
    """Remove one-line and block comments; version comments ``/*!`` stay."""
    sql = F.regexp_replace(_c(sql), ONE_LINE_COMMENT, "")
    return F.regexp_replace(sql, MULTI_LINE_COMMENT, "")


def clean_query(sql) -> Column:
    """Blank out block comments and squeeze white space."""
    sql = F.regexp_replace(_c(sql), r"/\*.*?\*/", " ")
    sql = F.regexp_replace(sql, r"\A\s+", "")
    sql = F.regexp_replace(sql, r"\s+\z", "")
    return F.regexp_replace(sql, r"\s{2,}", " ")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def fingerprint(sql) -> Column:
    """The class key of a statement: literals, lists and spacing abstracted away.

    One chain of rewrites: each step reads the one before once, so the text is
    passed over a fixed number of times.
    """
    sql = _c(sql)
    q = F.regexp_replace(sql, MULTI_ROW_INSERT + r".*\z", "$1")
    q = F.regexp_replace(strip_comments(q), USE_DB, "use ?")
    q = strip_quoted(q)
    q = F.regexp_replace(q, NUMBER_LIKE, "?")
    q = F.regexp_replace(q, NUMBER_LEFTOVER, "?")
    q = F.regexp_replace(q, r"\A\s+", "")
    q = F.regexp_replace(q, r"\n\z", "")
    q = F.lower(F.regexp_replace(q, r"[ \n\t\r\f]+", " "))
    q = F.regexp_replace(q, r"\bnull\b", "?")
    q = F.regexp_replace(q, VALUE_LIST, "$1(?+)")
    q = F.regexp_replace(q, REPEATED_UNION, "$1 /*repeat$2*/")
    q = F.regexp_replace(q, LIMIT_CLAUSE, "$1limit ?")
    return (
        F.when(sql.startswith(DUMP_PREFIX), F.lit("mysqldump"))
        .when(sql.rlike(CHECKSUM_MARK), F.lit(CHECKSUM_WORD))
        .when(sql.startswith(ADMIN_PREFIX), sql)
        .when(sql.rlike(CALL), F.lower(F.regexp_extract(sql, CALL, 1)))
        .otherwise(q)
    )


def _rewrite_matches(text: Column, pattern: str, rewrite) -> Column:
    """Replace each match of ``pattern`` by ``rewrite(match)``, both as columns."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(
        F.zip_with(between, found, lambda s, m: F.concat(s, F.coalesce(rewrite(m), F.lit("")))),
        "",
    )


def abstract_stmt(sql) -> Column:
    """The older abstraction: ``N`` and ``S`` placeholders, counted IN lists."""
    q = F.lower(_c(sql))
    q = F.regexp_replace(q, r"\b\d+\b", "N")
    q = F.regexp_replace(q, r"\b0x[0-9A-Fa-f]+\b", "N")
    q = F.regexp_replace(q, "''", "'S'")
    q = F.regexp_replace(q, '""', '"S"')
    q = F.regexp_replace(q, r"""\\['"]""", "")
    q = F.regexp_replace(q, "'[^']+'", "'S'")
    q = F.regexp_replace(q, '"[^"]+"', '"S"')
    q = F.regexp_replace(q, r"\A\s+", "")
    q = F.regexp_replace(q, r"\s{2,}", " ")
    q = F.regexp_replace(q, "\n", " ")
    q = F.regexp_replace(q, r"; (\w+) ", ";\n$1 ")

    def count_of(text: Column, letter: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))

    def counted(match: Column) -> Column:
        items = F.regexp_replace(match, r"(?i)\A in\s*\(", "")
        n, s = count_of(items, "N"), count_of(items, "S")
        return F.when(
            n > 0, F.concat(F.lit(" IN (N"), n.cast("string"), F.lit(")"))
        ).otherwise(F.concat(F.lit(" IN (S"), s.cast("string"), F.lit(")")))

    in_list = r"(?i) in\s*\((?![ns]\d+).+?\)"
    return _let(q, lambda x: F.when(x.rlike(in_list), _rewrite_matches(x, in_list, counted)).otherwise(x))


def shorten(sql, max_length: int) -> Column:
    """Cut multi-row VALUES and, past ``max_length``, IN lists beyond 20 items."""
    multi_row = (
        r"(?is)\A((?:INSERT|REPLACE)(?:\s+LOW_PRIORITY|DELAYED|HIGH_PRIORITY|IGNORE)?"
        r"(?:\s\w+)*\s+\S+\s+VALUES\s*\(.*?\))\s*,\s*\(.*?(ON\s+DUPLICATE|\z)"
    )
    q = F.regexp_replace(_c(sql), multi_row, "$1 /*... omitted ...*/$2")

    def cut(match: Column) -> Column:
        opening = F.regexp_extract(match, r"(?i)\A(IN\s*\()", 1)
        items = F.split(F.substr(match, F.length(opening) + 1), ",", -1)
        kept = F.array_join(F.slice(items, 1, IN_LIST_KEEP), ",")
        omitted = (F.size(items) - IN_LIST_KEEP).cast("string")
        note = F.concat(F.lit("/*... omitted "), omitted, F.lit(" items ...*/"))
        return F.when(
            F.size(items) > IN_LIST_KEEP, F.concat(opening, kept, note)
        ).otherwise(match)

    if max_length <= 0:
        return q

    def long_lists(x: Column) -> Column:
        wanted = (F.length(x) > max_length) & x.rlike(r"(?i)IN\s*\(\s*(?!select)")
        return F.when(wanted, _rewrite_matches(x, r"(?i)\bIN\s*\([^)]+(?=\))", cut)).otherwise(x)

    return _let(q, long_lists)


def _drop_adjacent(words: Column) -> Column:
    """Collapse runs of equal neighbours in an array of strings."""

    def new_ones(w: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), w)
        pairs = F.arrays_zip(w.alias("w"), before.alias("p"))
        kept = F.filter(pairs, lambda z: z["w"].isNotNull() & ~z["w"].eqNullSafe(z["p"]))
        return F.transform(kept, lambda z: z["w"])

    return _let(words, new_ones)


def _ddl_verb(sql: Column) -> Column:
    return F.regexp_extract(sql, rf"(?i)\A\s*({DDL_VERB})\b", 1)


def _ddl_table(sql: Column) -> Column:
    name = F.regexp_extract(sql, rf"(?i)(?:TABLE|DATABASE)\s+({IDENT})(?:\s+.*)?", 1)
    return F.when(name != "", name)


def distill_verbs(sql) -> Column:
    """The verbs of a statement in order, neighbours de-duplicated."""
    sql = _c(sql)
    return _let(strip_comments(sql), lambda q: _verbs(sql, q))


def _verbs(sql: Column, q: Column) -> Column:
    """Verbs of a statement; ``q`` is its text without comments."""

    def shown(words: Column) -> Column:
        first, second = F.upper(F.get(words, F.lit(0))), F.upper(F.get(words, F.lit(1)))
        return F.when(
            first.contains("CREATE") | second.contains("STATUS"),
            F.concat(F.lit("SHOW "), first, F.lit(" "), second),
        ).otherwise(F.concat(F.lit("SHOW "), first))

    show = _let(F.array(*[F.regexp_extract(q, SHOWN, i) for i in (1, 2)]), shown)
    obj = F.upper(F.regexp_extract(q, rf"(?i){DDL_VERB}.+(DATABASE|TABLE)\b", 1))
    words = F.transform(F.regexp_extract_all(q, F.lit(VERB), F.lit(1)), F.upper)
    verbs = F.regexp_replace(
        F.array_join(_drop_adjacent(words), " "), "( UNION SELECT)+", " UNION"
    )

    def defined(ddl: Column) -> Column:
        both = _let(obj, lambda o: F.when(o != "", F.concat_ws(" ", ddl, o)).otherwise(ddl))
        return F.when(ddl != "", both).otherwise(verbs)

    xa = F.regexp_extract(sql, XA, 1)
    return (
        F.when(sql.rlike(CALLED), F.concat(F.lit("CALL "), F.regexp_extract(sql, CALLED, 1)))
        .when(sql.rlike(r"\A# administrator"), F.lit("ADMIN"))
        .when(sql.rlike(r"\A\s*use\s+"), F.lit("USE"))
        .when(sql.rlike(r"(?i)\A\s*UNLOCK TABLES"), F.lit("UNLOCK"))
        .when(sql.rlike(XA), F.concat(F.lit("XA_"), xa))
        .when(q.rlike(r"(?i)\A\s*SHOW\s+\S"), show)
        .otherwise(_let(F.upper(_ddl_verb(q)), defined))
    )


def get_tables(sql) -> Column:
    """Names of the tables a statement touches, as ``ARRAY<STRING>``."""
    sql = _c(sql)
    ddl = _ddl_verb(sql)
    is_ddl = ddl != ""
    no_guard = F.regexp_replace(sql, r"(?is)\A(.*?)IF NOT EXISTS", "$1")
    from_select = F.regexp_extract(sql, r"(?is)\b(SELECT\b.+)", 1)
    is_ctas = (F.upper(ddl) == "CREATE") & sql.rlike(r"(?i)CREATE\b.+?\bSELECT\b")
    on_database = no_guard.rlike(rf"(?i){DDL_VERB} DATABASE\b")
    ddl_name = F.regexp_extract(no_guard, rf"(?i)TABLE\s+({IDENT})(?:\s+.*)?", 1)

    q = F.when(is_ddl, from_select).otherwise(sql)
    q = F.regexp_replace(q, r"(?i) (?:LOW_PRIORITY|IGNORE|STRAIGHT_JOIN)", "")
    locked = F.regexp_replace(q, r"\A(\s*LOCK TABLES\s+)", "")
    locked = F.concat(F.lit("FROM "), F.regexp_replace(locked, r"\s+(?:READ|WRITE|LOCAL)+\s*", ""))
    q = strip_quoted(F.when(q.rlike(r"(?i)\A\s*LOCK TABLES"), locked).otherwise(q))
    lists = F.regexp_extract_all(q, F.lit(TABLE_LIST), F.lit(1))
    names = F.flatten(F.transform(lists, lambda one: F.split(one, ",", -1)))
    names = F.transform(
        names, lambda n: F.regexp_replace(n, rf"(?i)\s*({IDENT})(\s+.*)?", "$1")
    )
    names = F.filter(names, lambda n: n.rlike("[a-zA-Z]"))
    none = F.array().cast("array<string>")
    return (
        F.when(is_ddl & on_database, none)
        .when(is_ddl & ~is_ctas, F.when(ddl_name != "", F.array(ddl_name)).otherwise(none))
        .otherwise(names)
    )


def distill_tables(sql) -> Column:
    """Table names with back-ticks dropped, digits masked, neighbours folded."""
    sql = _c(sql)
    return _let(strip_comments(sql), lambda q: _masked_tables(sql, q))


def _masked_tables(sql: Column, q: Column) -> Column:
    names = F.transform(
        get_tables(sql),
        lambda n: F.regexp_replace(F.replace(n, F.lit("`"), F.lit("")), "(_?)[0-9]+", "$1?"),
    )
    special = sql.rlike(r"(?i)\A(?:\s*(?:call\s+\S+\(|use\s|UNLOCK TABLES|xa\s+\S|SHOW\s)|# administrator)")
    own = F.when((_ddl_verb(q) != "") & ~special, F.array(_ddl_table(q)))
    return _drop_adjacent(F.concat(names, F.coalesce(own, F.array().cast("array<string>"))))


def distill(sql) -> Column:
    """Short form of a statement: its verbs, then its tables."""
    sql = _c(sql)
    return _let(strip_comments(sql), lambda q: F.array_join(F.concat(F.array(_verbs(sql, q)), _masked_tables(sql, q)), " "))


def distill_generic(request, trim_url: bool = False) -> Column:
    """Short form of a command or HTTP request: upper-case verb and its object."""
    request = _c(request)
    pattern = r"\A(\S+)\s+(\S+)"
    cmd = F.upper(F.regexp_extract(request, pattern, 1))
    short = F.concat_ws(" ", cmd, F.regexp_extract(request, pattern, 2))
    if trim_url:
        short = F.regexp_replace(short, r"(\S+ \S+?)[?;].+", "$1")
    return F.when(cmd == "", F.lit("")).otherwise(short)


def has_derived_table(sql) -> Column:
    return _c(sql).rlike(DERIVED_TABLE)


def split_statements(sql) -> Column:
    """Cut a compound statement before each verb that does not open a call."""
    boundary = (
        rf"(?i)(?<!on duplicate key\s{{1,8}})(?=\b{SPLIT_VERB}\b(?!\s*\())"
    )
    return F.filter(F.split(clean_query(sql), boundary, -1), lambda s: s != "")


def query_type(sql) -> Column:
    """``read``, ``write`` or NULL from the leading verb."""
    verbs = distill_verbs(sql)
    return F.when(verbs.rlike(r"\ASELECT\b"), F.lit("read")).when(
        verbs.rlike(rf"\A(?:{DML_VERB}|{DDL_VERB})\b"), F.lit("write")
    )


def key_fingerprint(key) -> Column:
    """Mask long hex runs and numbers of a cache key."""
    return F.regexp_replace(_c(key), KEY_PART, "?")


def key_value_flags(cmd, res) -> dict[str, Column]:
    """Yes/No columns describing a key-value request and its reply."""
    cmd, res = _c(cmd), _c(res)

    def yes(cond: Column) -> Column:
        return F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))

    flags = {f"Memc_{c}": yes(cmd.eqNullSafe(F.lit(c))) for c in KEY_VALUE_COMMANDS}
    has_res = res.isNotNull() & (res != "")
    stored = cmd.isin(*STORAGE_COMMANDS) & has_res
    retrieved = cmd.isin(*RETRIEVAL_COMMANDS) & has_res
    flags["Memc_miss"] = yes(res.eqNullSafe(F.lit("NOT_FOUND")))
    flags["Memc_error"] = yes(retrieved & (res == "INTERRUPTED"))
    flags["Memc_Not_Stored"] = F.when(stored, yes(res == "NOT_STORED"))
    flags["Memc_Exists"] = F.when(stored, yes(res == "EXISTS"))
    return flags


def class_id(text) -> Column:
    """Upper-case last 16 hex digits of the MD5 of a class key."""
    return F.upper(F.right(F.md5(_c(text)), F.lit(16)))


def class_checksum(text) -> Column:
    """The class id as an unsigned 64-bit decimal."""
    return F.conv(class_id(text), 16, 10).cast("decimal(20,0)")


def strip_auto_increment(ddl) -> Column:
    return F.regexp_replace(_c(ddl), r"AUTO_INCREMENT=\d+\s+", "")


def last_pairs(keys: Column, values: Column) -> Column:
    """Parallel arrays as a struct of two, ``k`` and ``v``, with each key once; of repeated keys the last counts."""

    def by_name(pairs: Column) -> Column:
        names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
        last = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"])
        return F.struct(names.alias("k"), last.alias("v"))

    def build(both: Column) -> Column:
        # Names that come once need no look-up.
        once = F.size(F.array_distinct(both["k"])) == F.size(both["k"])
        return F.when(once, both).otherwise(F.transform(F.array(F.arrays_zip(both["k"].alias("k"), both["v"].alias("v"))), by_name)[0])

    return F.transform(F.array(F.struct(keys.alias("k"), values.alias("v"))), build)[0]


def pairs_to_map(*pairs: Column) -> Column:
    """Map of what ``last_pairs`` gives; it is built once, and a key of several is an error."""
    def build(all_pairs: Column) -> Column:
        parts = [all_pairs[f"_{i}"] for i in range(len(pairs))]
        return F.map_from_arrays(F.concat(*(p["k"] for p in parts)), F.concat(*(p["v"] for p in parts)))

    return F.transform(F.array(F.struct(*(p.alias(f"_{i}") for i, p in enumerate(pairs)))), build)[0]


def pairs_of(text, pattern: str) -> Column:
    """``last_pairs`` of the two groups of every match of a pattern; the text is made once."""
    def build(one: Column) -> Column:
        return last_pairs(F.regexp_extract_all(one, F.lit(pattern), F.lit(1)), F.regexp_extract_all(one, F.lit(pattern), F.lit(2)))

    return F.transform(F.array(_c(text)), build)[0]


def embedded_pairs(sql, embed: str, capture: str) -> Column:
    """Key/value pairs hidden in a statement, later ones instead of earlier ones."""
    return pairs_of(F.regexp_extract(_c(sql), f"({embed})", 1), capture)


def embedded_attributes(sql, embed: str, capture: str) -> Column:
    """Key/value pairs hidden in a statement, as a map; later pairs win (S2)."""
    return pairs_to_map(embedded_pairs(sql, embed, capture))
