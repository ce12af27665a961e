"""Hex-dump packets as columns, and request/reply pairs of text protocols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import numbers
from fleetlens.operators import ordered
from fleetlens.sources.records import read_records

# --- Fixed values: packet line forms, flag bits and reply words. ------------------------
PACKET_SEPARATOR = "\n20"
ADDRESS_LINE = r"\A(\S+ \S+) IP .*?(\S+) > (\S+):"
HOST_PORT = r"((?:\d+\.){3}\d+)\.(\w+)"
HEX_LINE = r"\s+0x[0-9a-f]+:\s((?:\s[0-9a-f]{2,4})+)"
FIN, SYN, RST = 1, 2, 4
STORE_COMMANDS = ("set", "add")
COUNT_COMMANDS = ("incr", "decr")
KEY_VALUE_OPENING = r"\A(?i)(?:get|gets|set|add|replace|append|prepend|cas|delete|incr|decr|stats|version|quit|flush_all|verbosity) *[^\r\n]*\r\n"
HTTP_VERBS = ("get", "post")
HTTP_HOST = r"(?im)^Host: *(\S+)"
HTTP_LENGTH = r"(?im)^Content-Length: *(\d+)"
CRLF = "\r\n"
# -------------------------------------------------------------------------------------------


def read_packet_text(spark: SparkSession, path) -> DataFrame:
    return parse_packets(read_records(spark, path, PACKET_SEPARATOR))


def parse_packets(records: DataFrame) -> DataFrame:
    """Address, flags, sequence numbers and payload of each dumped packet."""
    value = F.when(F.col("value").startswith("20"), F.col("value")).otherwise(F.concat(F.lit("20"), "value"))
    x = records.filter("value <> ''").withColumn("_v", value)
    hexes = F.array_join(F.regexp_extract_all("_v", F.lit(HEX_LINE), F.lit(1)), "")
    x = x.withColumn("_hex", F.regexp_replace(hexes, r"\s+", ""))

    def number(start, length: int):
        return F.conv(F.substr(F.col("_hex"), start, F.lit(length)), 16, 10).cast("long")

    words = number(F.lit(2), 1)
    x = x.withColumns({"ip_hlen": words, "dgram_len": number(F.lit(5), 4)})
    at = lambda word, extra=0: (F.col("ip_hlen") + word) * 8 + 1 + extra
    x = x.withColumns({
        "seq": number(at(1).cast("int"), 8), "ack": number(at(2).cast("int"), 8),
        "tcp_hlen": number(at(3).cast("int"), 1), "_flags": number(at(3, 2).cast("int"), 2),
    })
    # The line of addresses is found once, in a column of its own, and taken apart alone.
    x = x.withColumn("_address", F.regexp_extract("_v", ADDRESS_LINE, 0))
    x = x.withColumns({"_src": F.regexp_extract("_address", ADDRESS_LINE, 2), "_dst": F.regexp_extract("_address", ADDRESS_LINE, 3)})
    x = x.withColumns({"_src_port": F.regexp_extract("_src", HOST_PORT, 2), "_dst_port": F.regexp_extract("_dst", HOST_PORT, 2)})
    head = (F.col("ip_hlen") + F.col("tcp_hlen")) * 8
    data = F.substr(F.col("_hex"), (head + 1).cast("int"))
    flag = lambda bit: F.col("_flags").bitwiseAND(F.lit(bit)) != 0
    return x.select(
        "file", "pos", F.regexp_extract("_address", ADDRESS_LINE, 1).alias("ts"),
        F.regexp_extract("_src", HOST_PORT, 1).alias("src_host"), numbers.port_number("_src_port").alias("src_port"),
        F.regexp_extract("_dst", HOST_PORT, 1).alias("dst_host"), numbers.port_number("_dst_port").alias("dst_port"),
        "seq", "ack", flag(FIN).alias("fin"), flag(SYN).alias("syn"), flag(RST).alias("rst"),
        (F.length("_hex") == F.col("dgram_len") * 2).alias("complete"), "ip_hlen", "tcp_hlen", "dgram_len",
        (F.col("dgram_len") - (F.col("ip_hlen") + F.col("tcp_hlen")) * 4).alias("data_len"), data.alias("data"),
    )


def exchanges(packets: DataFrame, server_port: str, order: list[str], block, opening: str | None = None) -> DataFrame:
    """Payload packets with the client, the side, the text and the number of the exchange.

    An exchange is the client packets up to the next client packet that follows a
    server packet, or whose text matches ``opening``. A busy client is many small
    groups, and these, not clients, are what is shuffled. ``next_ts`` on the last
    packet of an exchange is the time of the client packet that cuts it off. Hex
    digits that form no bytes give a NULL text, and so does a packet that was not
    captured whole, where ``packets`` tells so in ``complete``.
    """
    p = packets.filter((F.col("data_len") > 0) & ((F.col("src_port") == server_port) | (F.col("dst_port") == server_port)))
    from_server = F.col("src_port") == server_port
    client = F.when(from_server, F.concat_ws(":", "dst_host", "dst_port")).otherwise(F.concat_ws(":", "src_host", "src_port"))
    # A frame may be padded beyond its packet; it is cut short where bytes of the payload are missing.
    whole = F.col("complete") | (F.length("data") >= F.col("data_len") * 2) if "complete" in packets.columns else F.lit(True)
    text = F.when(F.coalesce(whole, F.lit(False)), F.decode(F.unhex("data"), "ISO-8859-1"))
    opens = text.rlike(opening) if opening else F.lit(False)
    p = p.withColumns({"client": client, "from_server": from_server, "text": text, "opens": F.coalesce(opens, F.lit(False))})
    return ordered.islands(
        p, ["from_server", "opens", "ts"], lambda before, row: ~row["from_server"] & (before["from_server"] | row["opens"]),
        order, block, ["client"], "exchange", ["ts"],
    )


def _seconds(start, end):
    """Difference of two packet times; past midnight when it would be negative."""
    diff = (F.unix_micros(end.try_cast("timestamp")) - F.unix_micros(start.try_cast("timestamp"))) / 1e6
    return F.when(diff < 0, diff + 86400).otherwise(diff)


def _sides(packets: DataFrame, server_port: str, order: list[str], block, opening: str | None) -> DataFrame:
    """One row per exchange: its first request, the reply's first packet and times, and the texts of both sides.

    Texts are put together by sequence number; one of a packet that was not
    captured whole is NULL.
    """
    cut = block if block is not None else ordered.time_block(F.to_timestamp("ts"), 3600)
    x = exchanges(packets, server_port, order, cut, opening)
    at, asked, answered = F.struct(*order), F.expr("not from_server"), F.col("from_server")
    packet = F.struct("seq", "text", "data_len")
    x = x.groupBy("client", "exchange").agg(
        F.min_by(F.when(asked, F.struct("src_host", "pos", "ts", "text")), F.when(asked, at)).alias("first"),
        F.array_sort(F.collect_list(F.when(asked, packet))).alias("sent"), F.array_sort(F.collect_list(F.when(answered, packet))).alias("got"),
        F.min_by(F.when(answered, F.col("ts")), F.when(answered, at)).alias("answered"), F.max_by(F.when(answered, F.col("ts")), F.when(answered, at)).alias("ended"),
        F.max_by("next_ts", at).alias("cut_off"),
    )

    def joined(side: str):
        return F.when(~F.exists(side, lambda p: p["text"].isNull()), F.array_join(F.transform(side, lambda p: p["text"]), ""))

    return x.filter("first is not null").withColumns({"request": joined("sent"), "reply": joined("got")})


def _line(text):
    return F.substring_index(text, CRLF, 1)


def _after_line(text):
    return F.when(F.instr(text, CRLF) > 0, F.substr(text, F.instr(text, CRLF) + 2)).otherwise("")


def key_value_requests(packets: DataFrame, server_port: str = "11211", order=("ts", "pos"), block=None) -> DataFrame:
    """Requests of a key-value text protocol with their answers; one without answer before the next is INTERRUPTED."""
    x = _sides(packets, server_port, list(order), block, KEY_VALUE_OPENING)
    asked = F.split(F.trim(_line(F.col("first.text"))), " +")
    said = F.split(F.trim(_line(F.col("reply"))), " +")
    x = x.withColumns({"asked": asked, "said": said, "cmd": F.lower(F.get(asked, F.lit(0))), "word": F.get(said, F.lit(0)), "body": _after_line(F.col("reply"))})
    stored, found = F.col("cmd").isin(*STORE_COMMANDS), F.col("word") == "VALUE"
    counted = F.col("cmd").isin(*COUNT_COMMANDS) & F.col("word").rlike(r"\A\d+\z")
    no_answer = F.col("answered").isNull()

    def argument(words: str, at: int):
        return F.get(F.col(words), F.lit(at))

    size = F.when(stored, argument("asked", 4)).when(found, argument("said", 3)).otherwise("0").try_cast("long")
    x = x.withColumn("bytes", F.coalesce(size, F.lit(0)))
    body = F.when(stored, F.substr(_after_line(F.col("request")), F.lit(1), F.col("bytes").cast("int")))
    val = F.when(no_answer, F.lit("")).when(counted, F.col("word")).when(found, F.substr(F.col("body"), F.lit(1), F.col("bytes").cast("int"))).otherwise(F.when(stored, body).otherwise(""))
    res = F.when(no_answer, "INTERRUPTED").when(counted, "").when(F.col("word") == "END", "NOT_FOUND").otherwise(F.col("word"))
    until = F.when(no_answer, F.col("cut_off")).when(found, F.col("ended")).otherwise(F.col("answered"))
    return x.filter(~no_answer | F.col("cut_off").isNotNull()).select(
        "client", F.col("first.src_host").alias("host"), "first.pos", "first.ts", "cmd", argument("asked", 1).alias("key"), val.alias("val"), res.alias("res"),
        F.coalesce(F.when(stored, argument("asked", 2)).when(found, argument("said", 2)), F.lit("0")).alias("flags"),
        F.coalesce(F.when(stored, argument("asked", 3)), F.lit("0")).alias("exptime"), "bytes", _seconds(F.col("first.ts"), until).alias("Query_time"),
    )


def http_requests(packets: DataFrame, server_port: str = "80", order=("ts", "pos"), block=None) -> DataFrame:
    """GET and POST requests whose replies came whole, judged by lengths; replies may arrive out of order."""
    x = _sides(packets, server_port, list(order), block, None)
    ask, head = F.split(_line(F.col("first.text")), " +"), F.filter("got", lambda p: p["text"].startswith("HTTP/"))
    x = x.withColumns({"ask": ask, "head": F.get(head, F.lit(0))["text"]})
    header = F.substring_index("head", CRLF + CRLF, 1)
    host = F.regexp_extract(_after_line(F.substring_index(F.col("first.text"), CRLF + CRLF, 1)), HTTP_HOST, 1)
    size = F.coalesce(F.regexp_extract(header, HTTP_LENGTH, 1).try_cast("long"), F.lit(0))
    have = F.aggregate("got", F.lit(0).cast("long"), lambda n, p: n + p["data_len"]) - F.length(header) - 4
    verb = F.lower(F.get("ask", F.lit(0)))
    x = x.filter(verb.isin(*HTTP_VERBS) & F.col("head").isNotNull() & (F.size("ask") >= 2)).withColumns({"host_name": host, "size": size, "have": have})
    return x.filter("have >= size").select(
        "client", F.col("first.src_host").alias("host"), "first.pos", "first.ts", F.concat(verb, F.lit(" "), "host_name", F.get("ask", F.lit(1))).alias("arg"),
        F.nullif("host_name", F.lit("")).alias("Virtual_host"), F.get(F.split(_line(F.col("head")), " +"), F.lit(1)).alias("Status_code"), F.col("size").alias("bytes"),
        _seconds(F.col("first.ts"), F.col("answered")).alias("Query_time"), _seconds(F.col("answered"), F.col("ended")).alias("Transmit_time"),
    )
