"""Further scalar functions: a query over a whole table for each, with SQL for DuckDB. Columns are made when a query is called."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import aggregates as A
from lodestone.session import table as T

KEYS = {"customer": "c_custkey", "events": "event_id", "pages": "page_id"}
c = F.col

#: Name, table, column, SQL.
FUNCTIONS: list[tuple[str, str, Callable[[], Column], str]] = [
    # --- arithmetic
    ("tidb_unary_minus_real", "customer", lambda: -c("c_acctbal"), "-c_acctbal"),
    ("tidb_unary_minus_decimal", "customer", lambda: (-c("c_acctbal").cast("decimal(12,2)")).cast("double"), "cast(-cast(c_acctbal as decimal(12,2)) as double)"),
    ("bit_rotate_right", "customer", lambda: S.rotate_left(c("c_custkey"), 64 - 1), "case when c_custkey % 2 = 0 then c_custkey // 2 else (c_custkey // 2) - 9223372036854775808 end"),
    ("ceil_decimal_to_int", "customer", lambda: F.ceil(c("c_acctbal").cast("decimal(12,2)")).cast("long"), "cast(ceil(cast(c_acctbal as decimal(12,2))) as bigint)"),
    ("floor_decimal_to_int", "customer", lambda: F.floor(c("c_acctbal").cast("decimal(12,2)")).cast("long"), "cast(floor(cast(c_acctbal as decimal(12,2))) as bigint)"),
    ("trunc_decimal_to_int", "customer", lambda: c("c_acctbal").cast("decimal(12,2)").cast("long"), "cast(trunc(c_acctbal) as bigint)"),
    ("exp2", "customer", lambda: F.pow(F.lit(2.0), c("c_nationkey")), "pow(2.0, c_nationkey)"),
    ("exp10", "customer", lambda: F.pow(F.lit(10.0), c("c_nationkey") % 9), "pow(10.0, c_nationkey % 9)"),
    ("log2args", "customer", lambda: F.round(F.log(3.0, c("c_custkey")), 6), "case when c_custkey > 0 then round(ln(c_custkey) / ln(3), 6) end"),
    # --- comparison and logic
    ("greater", "customer", lambda: c("c_acctbal") > c("c_nationkey"), "c_acctbal > c_nationkey"),
    ("less_or_equals", "customer", lambda: c("c_acctbal") <= c("c_nationkey") * 100, "c_acctbal <= c_nationkey * 100"),
    ("is_true_with_null", "customer", lambda: F.nullif(c("c_nationkey"), F.lit(3)) != 0, "nullif(c_nationkey, 3) <> 0"),
    ("is_false_with_null", "customer", lambda: F.nullif(c("c_nationkey"), F.lit(3)) == 0, "nullif(c_nationkey, 3) = 0"),
    ("tuple", "customer", lambda: F.to_json(F.array("c_custkey", c("c_nationkey").cast("long"))), "to_json([c_custkey, c_nationkey])::varchar"),
    ("tidb_in", "customer", lambda: F.nullif(c("c_nationkey"), F.lit(3)).isin(1, 3, 5), "nullif(c_nationkey, 3) in (1, 3, 5)"),
    ("tidb_not_in", "customer", lambda: ~F.nullif(c("c_nationkey"), F.lit(3)).isin(1, 5), "nullif(c_nationkey, 3) not in (1, 5)"),
    # --- casts
    ("tidb_cast_overflow", "customer", lambda: S.text_to_int(F.concat(F.when(c("c_nationkey") % 2 == 0, "-").otherwise(" +"), F.repeat(F.lit("9"), c("c_nationkey")), F.lit("x"))), "case when c_nationkey = 0 then 0 when c_nationkey > 18 then case when c_nationkey % 2 = 0 then -9223372036854775808 else 9223372036854775807 end else (case when c_nationkey % 2 = 0 then -1 else 1 end) * cast(repeat('9', least(c_nationkey, 18)) as bigint) end"),
    ("to_u_int8_wrapped", "customer", lambda: F.pmod(-c("c_custkey"), F.lit(256)), "cast((256 - c_custkey % 256) % 256 as bigint)"),
    ("to_u_int16", "customer", lambda: F.pmod(-c("c_custkey") * 7, F.lit(65536)), "cast((65536 - c_custkey * 7 % 65536) % 65536 as bigint)"),
    ("to_u_int32", "customer", lambda: F.pmod(-c("c_custkey"), F.lit(1 << 32)), "(4294967296 - c_custkey) % 4294967296"),
    ("to_u_int64", "customer", lambda: S.unsigned(-c("c_custkey")).cast("string"), "cast((18446744073709551616::hugeint - c_custkey) % 18446744073709551616::hugeint as varchar)"),
    ("to_float32", "customer", lambda: c("c_acctbal").cast("float").cast("double"), "cast(cast(c_acctbal as float) as double)"),
    ("to_date_or_null", "customer", lambda: F.concat(F.lit("2024-02-"), F.lpad((c("c_nationkey") + 10).cast("string"), 2, "0")).try_cast("date"), "try_cast('2024-02-' || (c_nationkey + 10) as date)"),
    ("to_date_or_zero", "customer", lambda: F.coalesce(F.concat(F.lit("2024-02-"), (c("c_nationkey") + 10).cast("string")).try_cast("date"), F.lit("1970-01-01").cast("date")), "coalesce(try_cast('2024-02-' || (c_nationkey + 10) as date), date '1970-01-01')"),
    ("to_date_time_or_null", "customer", lambda: F.concat(F.lit("2024-02-01 "), (c("c_nationkey") + 10).cast("string"), F.lit(":00:00")).try_cast("timestamp_ntz"), "case when c_nationkey < 14 then try_cast('2024-02-01 ' || (c_nationkey + 10) || ':00:00' as timestamp) end"),
    ("to_float_or_zero", "customer", lambda: F.coalesce(F.concat(c("c_acctbal").cast("decimal(12,2)").cast("string"), F.when(c("c_nationkey") > 5, "z").otherwise("")).try_cast("double"), F.lit(0.0)), "case when c_nationkey > 5 then 0 else c_acctbal end"),
    ("half_md5_u_int64", "customer", lambda: F.conv(F.substring(F.md5("c_name"), 1, 16), 16, 10), "cast(cast('0x' || left(md5(c_name), 16) as ubigint) as varchar)"),
    # --- text
    ("ltrim", "customer", lambda: S.trim_text(F.concat(F.lit("xx"), c("c_name"), F.lit("xx")), "x", right=False), "c_name || 'xx'"),
    ("rtrim", "customer", lambda: S.trim_text(F.concat(F.lit("xx"), c("c_name"), F.lit("xx")), "x", left=False), "'xx' || c_name"),
    ("replace_regexp_all", "customer", lambda: F.regexp_replace("c_name", "([1-9])", "<$1>"), r"regexp_replace(c_name, '([1-9])', '<\1>', 'g')"),
    ("like3_args", "customer", lambda: F.like(F.concat(c("c_name"), F.lit("%")), F.lit("%1!%"), F.lit("!")), "(c_name || '%') like '%1!%' escape '!'"),
    ("ilike3_args", "customer", lambda: F.ilike(F.concat(c("c_name"), F.lit("%")), F.lit("CUST%1!%"), F.lit("!")), "(c_name || '%') ilike 'CUST%1!%' escape '!'"),
    ("regexp_instr_pattern", "customer", lambda: S.regexp_instr(c("c_name"), "[1-9]"), "case when regexp_matches(c_name, '[1-9]') then length(regexp_extract(c_name, '^[^1-9]*')) + 1 else 0 end"),
    ("regexp_instr_occurrence", "customer", lambda: S.regexp_instr(c("c_name"), "[1-9]", 3, 2), "case when regexp_matches(c_name, '[1-9][^1-9]*[1-9]') then length(regexp_extract(c_name, '^[^1-9]*[1-9][^1-9]*')) + 1 else 0 end"),
    ("regexp_instr_after", "customer", lambda: S.regexp_instr(c("c_name"), "[1-9]+", 1, 1, True), "case when regexp_matches(c_name, '[1-9]') then length(regexp_extract(c_name, '^[^1-9]*[1-9]+')) + 1 else 0 end"),
    ("inet_aton_short", "customer", lambda: S.inet_aton(F.concat(F.when(c("c_nationkey") % 2 == 0, "0001.").otherwise(".."), c("c_custkey").cast("string"))), "case when c_custkey > 255 then null when c_nationkey % 2 = 0 then 16777216 + c_custkey else c_custkey end"),
    # --- dates
    ("date_format_weeks", "events", lambda: S.date_format(c("ts"), "%w|%U|%v|%x at %H"), "strftime(ts, '%w|%U|%V|%G at %H')"),
    ("date_format_day", "events", lambda: S.date_format(c("ts"), "%D"), "day(ts) || case when day(ts) between 11 and 13 then 'th' when day(ts) % 10 = 1 then 'st' when day(ts) % 10 = 2 then 'nd' when day(ts) % 10 = 3 then 'rd' else 'th' end"),
    ("date_format_monday_weeks", "events", lambda: S.date_format(c("ts"), "%u"), "case when isoyear(ts) < year(ts) then '00' when isoyear(ts) > year(ts) then '53' else strftime(ts, '%V') end"),
    ("tidb_unix_timestamp_decimal", "events", lambda: (F.unix_micros(c("ts").cast("timestamp")).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(20,0)")).cast("decimal(26,6)"), "cast(cast(epoch_us(ts) as decimal(26,6)) / 1000000 as decimal(26,6))"),
    ("to_unix_timestamp", "events", lambda: F.unix_timestamp(c("ts").cast("timestamp")), "cast(floor(epoch(ts)) as bigint)"),
    ("add_seconds", "events", lambda: c("ts") + F.expr("interval 90 seconds"), "ts + interval 90 seconds"),
    ("add_minutes", "events", lambda: c("ts") + F.expr("interval 61 minutes"), "ts + interval 61 minutes"),
    ("add_weeks", "events", lambda: F.date_add(c("ts").cast("date"), 21), "ts::date + 21"),
    ("subtract_seconds", "events", lambda: c("ts") - F.expr("interval 90 seconds"), "ts - interval 90 seconds"),
    ("subtract_hours", "events", lambda: c("ts") - F.expr("interval 30 hours"), "ts - interval 30 hours"),
    ("subtract_weeks", "events", lambda: F.date_sub(c("ts").cast("date"), 14), "ts::date - 14"),
    ("subtract_months", "events", lambda: F.add_months(c("ts").cast("date"), -1), "(ts::date - interval 1 month)::date"),
    ("subtract_years", "events", lambda: F.add_months(c("ts").cast("date"), -24), "(ts::date - interval 2 years)::date"),
    ("to_relative_quarter_num", "events", lambda: S.relative("quarter", c("ts")), "cast(year(ts) * 4 + (month(ts) - 1) // 3 as bigint)"),
    ("to_relative_week_num", "events", lambda: S.relative("week", c("ts")), "cast((datediff('day', date '1970-01-01', ts::date) + 3) // 7 as bigint)"),
    ("to_relative_second_num", "events", lambda: S.relative("second", c("ts")), "cast(floor(epoch(ts)) as bigint)"),
    ("date_diff_month", "events", lambda: S.date_diff("month", F.lit("2023-11-30").cast("timestamp_ntz"), c("ts")), "datediff('month', date '2023-11-30', ts::date)"),
    ("date_diff_hour", "events", lambda: S.date_diff("hour", F.lit("2023-11-30 23:59:59").cast("timestamp_ntz"), c("ts")), "datediff('hour', timestamp '2023-11-30 23:59:59', ts)"),
    # --- durations, from below -100 hours to above
    *(
        (f"duration_{unit}", "events", lambda unit=unit: S.duration_part((c("event_id") - 500) * 1234567891, unit), sql)
        for unit, sql in (
            ("hour", "abs((event_id - 500) * 1234567891) // 3600000000"),
            ("minute", "abs((event_id - 500) * 1234567891) // 60000000 % 60"),
            ("second", "abs((event_id - 500) * 1234567891) // 1000000 % 60"),
            ("micro_second", "abs((event_id - 500) * 1234567891) % 1000000"),
        )
    ),
    ("extract_my_duration", "events", lambda: S.extract_duration((c("event_id") - 500) * 1234567891, "DAY_MICROSECOND"), "sign(event_id - 500)::bigint * ((abs((event_id - 500) * 1234567891) // 3600000000) * 10000000000 + (abs((event_id - 500) * 1234567891) // 60000000 % 60) * 100000000 + (abs((event_id - 500) * 1234567891) % 60000000))"),
    ("convert_duration_from_nanos", "events", lambda: S.duration_from_nanos((c("event_id") - 500) * 777), "sign(event_id - 500)::bigint * (abs((event_id - 500) * 777) // 1000)"),
    # --- JSON, made deeper by expressions
    ("json_depth", "events", lambda: S.json_depth(F.concat(F.repeat(F.lit('[{"]": []}, '), (c("user_id") % 5).cast("int")), c("props"), F.repeat(F.lit("]"), (c("user_id") % 5).cast("int")))), "user_id % 5 + 2"),
    ("json_depth_of_scalars", "events", lambda: S.json_depth(F.when(c("user_id") % 3 == 0, c("user_id").cast("string")).when(c("user_id") % 3 == 1, "[ ]").otherwise("[1, {}]")), "case when user_id % 3 = 2 then 2 else 1 end"),
    ("json_length_of_any", "events", lambda: S.json_length(F.when(c("user_id") % 3 == 0, '"text"').when(c("user_id") % 3 == 1, F.concat(F.lit("["), c("props"), F.lit(", 2]"))).otherwise(c("props"))), "case user_id % 3 when 0 then 1 when 1 then 2 else len(json_keys(props)) end"),
    ("json_extract_wildcard", "events", lambda: F.get_json_object(F.concat(F.lit("["), c("props"), F.lit(","), c("props"), F.lit("]")), "$[*].k"), "'[' || (props -> '$.k')::varchar || ',' || (props -> '$.k')::varchar || ']'"),
    ("cast_real_as_json", "events", lambda: F.to_json(F.array(c("user_id") + 0.5)), "'[' || cast(user_id + 0.5 as varchar) || ']'"),
    ("cast_string_as_json", "events", lambda: F.to_json(F.array(F.concat(F.lit('a"'), c("user_id").cast("string")))), "to_json(['a\"' || user_id])::varchar"),
    # --- URLs
    ("path_full", "pages", lambda: F.regexp_extract("url", r"^[a-z]+://[^/?#]*(.*)$", 1), r"regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1)"),
    ("query_string_and_fragment", "pages", lambda: F.regexp_extract("url", r"[?](.*)$", 1), r"regexp_extract(url, '[?](.*)$', 1)"),
    ("cut_query_string_and_fragment", "pages", lambda: F.regexp_replace("url", r"[?#].*$", ""), r"regexp_replace(url, '[?#].*$', '')"),
    ("cut_url_parameter", "pages", lambda: F.regexp_replace("url", r"([?&])page=[^&#]*&?", "$1"), r"regexp_replace(url, '([?&])page=[^&#]*&?', '\1', 'g')"),
    ("decode_url_component_text", "pages", lambda: F.url_decode(F.concat(F.lit("%C3%A9%20"), c("page_id").cast("string"), F.lit("%2F"))), "'é ' || page_id || '/'"),
    # --- special functions
    ("erf", "customer", lambda: F.round(S.erf((c("c_nationkey") - 12) / 5), 9), "round(2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n: (-1) ** n * ((c_nationkey - 12) / 5) ** (2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))), 9)"),
    ("erfc", "customer", lambda: F.round(1 - S.erf((c("c_nationkey") - 12) / 5), 9), "round(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n: (-1) ** n * ((c_nationkey - 12) / 5) ** (2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))), 9)"),
    ("lgamma", "customer", lambda: F.round(S.lgamma(c("c_custkey") / 7 - 2.5), 6), "round(lgamma(c_custkey / 7 - 2.5), 6)"),
    ("tgamma", "customer", lambda: F.round(S.tgamma(c("c_nationkey") / 7 - 1.5), 6), "round(gamma(c_nationkey / 7 - 1.5), 6)"),
    # --- IPv6
    ("tidb_ipv6_string_to_num", "customer", lambda: F.lower(F.hex(S.inet6_aton(F.concat(F.lit("2001:db8::"), F.lower(F.hex("c_nationkey")), F.lit(":7"))))), "'20010db8' || repeat('0', 16) || lpad(lower(to_hex(c_nationkey)), 4, '0') || '0007'"),
    ("ipv6_string_to_num_mapped", "customer", lambda: F.lower(F.hex(S.inet6_aton(F.concat(F.lit("::ffff:1.2.3."), c("c_custkey").cast("string"))))), "case when c_custkey < 256 then repeat('0', 20) || 'ffff010203' || lpad(lower(to_hex(c_custkey)), 2, '0') end"),
    ("tidb_ipv6_num_to_string", "customer", lambda: S.inet6_ntoa(F.unhex(F.concat(F.lit("20010db8"), F.repeat(F.lit("0"), 16), F.lpad(F.hex("c_nationkey"), 4, "0"), F.lit("0007")))), "case when c_nationkey = 0 then '2001:db8::7' else '2001:db8::' || lower(to_hex(c_nationkey)) || ':7' end"),
    ("is_ipv6", "customer", lambda: S.is_ipv6(F.concat(F.repeat(F.lit("a:"), c("c_nationkey")), F.when(c("c_custkey") % 2 == 0, ":1").otherwise("1"))), "case when c_custkey % 2 = 0 then c_nationkey between 1 and 6 else c_nationkey = 7 end"),
    ("cut_ipv6", "customer", lambda: S.inet6_ntoa(F.unhex(F.concat(F.left(F.hex(S.inet6_aton(F.concat(F.lit("2001:db8::"), F.lit("1:2")))), F.lit(28)), F.lit("0000")))), "'2001:db8::1:0'"),
    ("ipv4_to_ipv6", "customer", lambda: F.lower(F.hex(S.ipv4_to_ipv6(c("c_custkey") * 70000))), "repeat('0', 20) || 'ffff' || lpad(lower(to_hex(c_custkey * 70000)), 8, '0')"),
    ("ipv4_num_to_string_class_c", "customer", lambda: F.concat(F.substring_index(S.inet_ntoa(c("c_custkey") * 70000), ".", 3), F.lit(".xxx")), "concat_ws('.', ((c_custkey * 70000) >> 24) & 255, ((c_custkey * 70000) >> 16) & 255, ((c_custkey * 70000) >> 8) & 255, 'xxx')"),
    # --- further conversions, text
    ("to_int16", "customer", lambda: c("c_nationkey").cast("smallint"), "cast(c_nationkey as smallint)"),
    ("to_int64", "customer", lambda: c("c_acctbal").cast("long"), "cast(trunc(c_acctbal) as bigint)"),
    ("to_nullable", "customer", lambda: F.nullif(c("c_nationkey"), F.lit(-1)), "c_nationkey"),
    ("to_uuid", "customer", lambda: F.regexp_replace(F.md5("c_name"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), "cast(cast(md5(c_name) as uuid) as varchar)"),
    ("hex_native", "customer", lambda: F.hex(c("c_name").cast("binary")), "hex(c_name)"),
    ("unhex_native", "customer", lambda: F.unhex(F.concat(F.lit("41"), F.lpad(F.hex(c("c_nationkey") + 65), 2, "0"))).cast("string"), "'A' || chr(c_nationkey + 65)"),
    ("tidb_greatest_string", "customer", lambda: F.greatest(c("c_mktsegment"), F.lit("HOUSEHOLD")), "greatest(c_mktsegment, 'HOUSEHOLD')"),
    ("tidb_least_string", "customer", lambda: F.least(c("c_mktsegment"), F.lit("HOUSEHOLD")), "least(c_mktsegment, 'HOUSEHOLD')"),
    ("upper_binary", "customer", lambda: F.upper(c("c_name")), "upper(c_name)"),
    ("reverse", "customer", lambda: F.reverse(c("c_mktsegment")), "reverse(c_mktsegment)"),
    # --- dates and times
    ("today", "events", lambda: F.datediff(F.current_date(), c("ts")), "datediff('day', ts::date, cast(now() at time zone 'UTC' as date))::int"),
    ("yesterday", "events", lambda: F.datediff(F.date_sub(F.current_date(), 1), c("ts")), "datediff('day', ts::date, cast(now() at time zone 'UTC' as date))::int - 1"),
    ("now", "events", lambda: F.now() > c("ts").cast("timestamp"), "now() at time zone 'UTC' > ts"),
    ("sys_date_with_fsp", "events", lambda: F.length(F.date_format(F.now(), "yyyy-MM-dd HH:mm:ss.SSS")), "23"),
    ("convert_time_zone_by_name", "events", lambda: F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), c("ts")), "ts + interval 8 hours"),
    ("convert_time_zone_to_utc", "events", lambda: F.convert_timezone(F.lit("Asia/Kolkata"), F.lit("UTC"), c("ts")), "ts - interval 330 minutes"),
    ("time_slots", "events", lambda: S.time_slots(c("ts"), c("user_id") % 9000), "range((epoch(ts)::bigint_ // 1800) * 1800, ((epoch_ + user_id % 9000) // 1800) * 1800 + 1, 1800)".replace("epoch(ts)::bigint_", "cast(floor(epoch(ts)) as bigint)").replace("epoch_", "cast(floor(epoch(ts)) as bigint)")),
    ("str_to_date_date", "events", lambda: S.str_to_date(F.date_format("ts", "dd.MM.yyyy"), "%d.%m.%Y").cast("date"), "ts::date"),
    ("parse_date_time_best_effort", "events", lambda: S.parse_date_time_best_effort(F.when(c("event_id") % 4 == 0, F.date_format("ts", "dd.MM.yyyy HH:mm:ss")).when(c("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(c("event_id") % 4 == 2, F.unix_timestamp(c("ts").cast("timestamp")).cast("string")).otherwise("soon")), "case when event_id % 4 < 3 then date_trunc('second', ts)::timestamp end"),
    ("extract_my_date_time_from_string", "events", lambda: F.date_format(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").try_cast("timestamp_ntz"), "yyyyMM").cast("long"), "cast(strftime(ts, '%Y%m') as bigint)"),
    *(
        (f"to_interval_{unit}", "events", lambda place=place: c("ts") + F.make_interval(*(F.lit(0) if i != place else (c("user_id") % 40).cast("int") for i in range(7))), f"ts + to_{unit}s(cast(user_id % 40 as int))")
        for place, unit in enumerate(("year", "month", "week", "day", "hour", "minute", "second"))
    ),
    # --- JSON
    ("json_contains_path_all", "events", lambda: S.json_contains_path(F.concat(F.lit('{"a": null, "b": '), c("props"), F.lit("}")), "all", "$.a", "$.b.k"), "json_exists(props, '$.k')"),
    ("json_contains_path_one", "events", lambda: S.json_contains_path(c("props"), "one", "$.none", "$.k"), "json_exists(props, '$.k')"),
    ("json_unquote_text", "events", lambda: S.json_unquote(F.concat(F.lit('"a\\"\\u00e9'), c("user_id").cast("string"), F.when(c("user_id") % 2 == 0, '"').otherwise(""))), "case when user_id % 2 = 0 then 'a\"é' || user_id else '\"a\\\"\\u00e9' || user_id end"),
    ("json_keys_2_args", "events", lambda: F.to_json(F.json_object_keys(F.get_json_object(F.concat(F.lit('{"a": '), c("props"), F.lit("}")), "$.a"))), "to_json(json_keys(props))::varchar"),
    ("json_extract_paths", "events", lambda: F.concat(F.lit("["), F.concat_ws(",", F.get_json_object("props", "$.k"), F.get_json_object("props", "$.none")), F.lit("]")), "'[' || coalesce((props -> '$.k')::varchar, '') || ']'"),
    # --- registrable domains
    ("first_significant_subdomain", "pages", lambda: S.first_significant_subdomain(F.when(c("page_id") % 3 == 0, F.lit("http://www.a.shop.co.uk/x")).otherwise(c("url"))), "case when page_id % 3 = 0 then 'shop' else regexp_extract(url, '([^./]+)[.][^./]+([/?#]|$)', 1) end"),
    ("cut_to_first_significant_subdomain", "pages", lambda: S.cut_to_first_significant_subdomain(F.when(c("page_id") % 3 == 0, F.lit("http://www.a.shop.co.uk/x")).otherwise(c("url"))), "case when page_id % 3 = 0 then 'shop.co.uk' else regexp_extract(url, '([^./]+[.][^./]+)([/?#]|$)', 1) end"),
]


def define(register: Callable[..., None]) -> None:
    for name, where, column, sql in FUNCTIONS:
        key = KEYS[where]
        register(f"fn_{name}", lambda s, d, where=where, key=key, column=column: T(s, d, where).select(c(key).alias("k"), column().alias("v")), f"select {key} as k, {sql} as v from {where}")
    register(
        "agg_bit_and_unsigned",
        lambda s, d: T(s, d, "customer").groupBy("c_nationkey").agg(A.bit_and(-c("c_custkey")).cast("string").alias("v")),
        "select c_nationkey, cast((18446744073709551616::hugeint + bit_and(-c_custkey)) % 18446744073709551616::hugeint as varchar) as v from customer group by c_nationkey",
    )
