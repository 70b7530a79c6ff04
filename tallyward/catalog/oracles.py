"""Plain SQL for every catalogue query, written independently of the DataFrame plans.

Positions, ranks and exact-size samples use simple global windows and LIMIT here; the
point is to be obviously right on a small table, not to scale.
"""

from __future__ import annotations

from collections.abc import Sequence

AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"
EVENTS_AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"
NAMES = ("clean", "duplicated", "dropped", "corrupted", "schema_drift", "out_of_order", "mixed")
FLOAT_TEXT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
INT_TEXT = r"^\s*[+-]?\d+\s*$"
ISO_TEXT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"
EVENT_COLUMNS = (
    "seq, event_id, event_time, customer_id, source_system, amount, status, version, checksum"
)
PAYLOAD = ("amount", "customer_id", "event_id", "event_time")


# --- Expressions ----------------------------------------------------------------


def h32(salt: str, key: str) -> str:
    return f"('0x' || substr(md5(concat('{salt}|', CAST({key} AS VARCHAR))), 1, 8))::BIGINT"


def h60(salt: str, key: str) -> str:
    return f"('0x' || substr(md5(concat('{salt}|', CAST({key} AS VARCHAR))), 1, 15))::BIGINT"


def bucket(salt: str, key: str, buckets: int = 10_000) -> str:
    return f"({h32(salt, key)} % {buckets})"


def sampled(salt: str, key: str, rate: float) -> str:
    return f"({h60(salt, key)} < {int(rate * 2**60)})"


def between(salt: str, key: str, low: int, high: int) -> str:
    return f"({bucket(salt, key, high - low + 1)} + {low})"


def number(text: str, kind: str) -> str:
    pattern = INT_TEXT if kind == "INTEGER" else FLOAT_TEXT
    return f"CASE WHEN regexp_matches({text}, '{pattern}') THEN TRY_CAST(trim({text}) AS {kind}) END"


def row_digest(columns: Sequence[str]) -> str:
    text = "CAST({c} AS VARCHAR)"
    items = [
        f"'{c}=' || CASE WHEN {c} IS NULL THEN '\\N' ELSE length({text.format(c=c)}) || ':' || {text.format(c=c)} END"
        for c in sorted(columns)
    ]
    return f"md5(concat_ws('|', {', '.join(items)}))"


def tax(decimal: str) -> str:
    return f"CAST(round({decimal} * CAST(0.10 AS DECIMAL(3,2)), 2) AS DOUBLE)"


CHECKSUM = "md5(concat_ws('|', event_id, customer_id, amount, event_time))"
NO_FAULTS = "CAST([] AS VARCHAR[])"


def comma(columns: Sequence[str]) -> str:
    return "".join(f"{c}, " for c in columns)


def group(columns: Sequence[str]) -> str:
    return f"GROUP BY {', '.join(columns)}" if columns else ""


def partition(columns: Sequence[str]) -> str:
    return f"PARTITION BY {', '.join(columns)}" if columns else ""


def using(columns: Sequence[str]) -> str:
    return f"USING ({', '.join(columns)})" if columns else "ON TRUE"


# --- Common table expressions ---------------------------------------------------


class With:
    """Named steps of one statement, in order."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, str]] = []

    def add(self, name: str, sql: str) -> str:
        if name not in [n for n, _ in self.steps]:
            self.steps.append((name, sql))
        return name

    def select(self, sql: str) -> str:
        if not self.steps:
            return sql
        return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in self.steps) + "\n" + sql


def events(w: With) -> str:
    w.add(
        "ev0",
        """SELECT CAST(regexp_extract(o_orderpriority, '^[0-9]+') AS BIGINT) AS dataset, o_orderkey AS seq,
            printf('order-%06d', o_orderkey) AS event_id,
            strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS event_time,
            printf('cust-%06d', o_custkey) AS customer_id, 'web' AS source_system,
            CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount,
            CASE o_orderstatus WHEN 'O' THEN 'created' WHEN 'P' THEN 'paid' WHEN 'F' THEN 'shipped' END AS status,
            '1' AS version FROM orders""",
    )
    return w.add("ev", f"SELECT *, {CHECKSUM} AS checksum, {NO_FAULTS} AS faults FROM ev0")


def missing(w: With, src: str, rate: float, name: str) -> str:
    return w.add(name, f"SELECT * FROM {src} WHERE NOT {sampled('drop', 'seq', rate)}")


def duplicates(w: With, src: str, rate: float, name: str, base: str = "") -> str:
    return w.add(
        name,
        f"""SELECT * FROM {src} UNION ALL
        SELECT * REPLACE (seq + (SELECT max(seq) + 1 FROM {base or src}) AS seq,
            list_append(faults, 'duplication') AS faults)
        FROM {src} WHERE {sampled('dup', 'seq', rate)}""",
    )


def corruption(w: With, src: str, rate: float, name: str) -> str:
    dec = number("amount", "DECIMAL(30,10)")
    return w.add(
        name,
        f"""SELECT * REPLACE (
            coalesce(CAST(CAST(({dec}) * 10 + 1 AS DECIMAL(20,2)) AS VARCHAR), amount) AS amount,
            'invalid' AS checksum, list_append(faults, 'corruption') AS faults)
        FROM {src} WHERE {sampled('corrupt', 'seq', rate)}
        UNION ALL SELECT * FROM {src} WHERE NOT {sampled('corrupt', 'seq', rate)}""",
    )


def drift(w: With, src: str, rate: float, name: str) -> str:
    return w.add(
        name,
        f"""SELECT * REPLACE ('N/A' AS amount, list_append(faults, 'schema_drift') AS faults)
        FROM {src} WHERE {sampled('drift', 'seq', rate)}
        UNION ALL SELECT * FROM {src} WHERE NOT {sampled('drift', 'seq', rate)}""",
    )


def out_of_order(w: With, src: str, rate: float, name: str, base: str = "") -> str:
    sample = sampled("ooo", "seq", min(1.0, 2 * rate))
    w.add(
        f"{name}_pick",
        f"""SELECT *, {h32('oooG', 'seq')} %
            greatest(1, CAST(ceil((SELECT max(seq) + 1 FROM {base or src}) / 4096.0) AS BIGINT)) AS grp
        FROM {src} WHERE {sample}""",
    )
    w.add(
        f"{name}_pair",
        f"""SELECT * EXCLUDE (grp, rn, nx, pv), CASE WHEN rn % 2 = 1 THEN nx ELSE pv END AS partner FROM (
            SELECT *, row_number() OVER g AS rn, lead(seq) OVER g AS nx, lag(seq) OVER g AS pv
            FROM {name}_pick WINDOW g AS (PARTITION BY grp ORDER BY {h32('ooo', 'seq')}, seq))""",
    )
    return w.add(
        name,
        f"""SELECT * FROM {src} WHERE NOT {sample} UNION ALL
        SELECT * EXCLUDE (partner) REPLACE (coalesce(partner, seq) AS seq,
            CASE WHEN partner IS NULL THEN faults ELSE list_append(faults, 'inconsistency') END AS faults)
        FROM {name}_pair""",
    )


def inject(w: With, scenario: str, src: str = "ev") -> str:
    if scenario == "clean":
        return src
    if scenario == "duplicated":
        return duplicates(w, src, 0.2, "s_duplicated")
    if scenario == "dropped":
        return missing(w, src, 0.2, "s_dropped")
    if scenario == "corrupted":
        return corruption(w, src, 0.2, "s_corrupted")
    if scenario == "schema_drift":
        return drift(w, src, 0.2, "s_drift")
    if scenario == "out_of_order":
        return out_of_order(w, src, 0.2, "s_ooo")
    one = missing(w, src, 0.1, "m_missing")
    two = duplicates(w, one, 0.1, "m_dup", src)
    three = corruption(w, two, 0.1, "m_corrupt")
    return out_of_order(w, three, 0.1, "s_mixed", src)


def all_scenarios(w: With, names: Sequence[str] = NAMES, src: str = "ev") -> str:
    frames = [(n, inject(w, n, src)) for n in names]
    return w.add(
        "faulted",
        " UNION ALL ".join(
            f"SELECT '{n}' AS scenario, dataset, {EVENT_COLUMNS}, faults FROM {f}" for n, f in frames
        ),
    )


def all_sources(w: With, names: Sequence[str] = NAMES, src: str = "ev") -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return w.add("sources", f"SELECT scenario, {src}.* FROM {src}, (SELECT unnest([{listed}]) AS scenario)")


def annotated(w: With, src: str, name: str = "ann") -> str:
    dec = number("amount", "DECIMAL(30,10)")
    w.add(
        f"{name}0",
        f"""SELECT *, {number('amount', 'DOUBLE')} AS amount_num, {dec} AS amount_dec,
            {number('version', 'INTEGER')} AS version_num,
            CASE WHEN regexp_matches(event_time, '{ISO_TEXT}') THEN TRY_CAST(event_time AS TIMESTAMP) END AS event_ts,
            (event_id IS NOT NULL AND event_time IS NOT NULL AND customer_id IS NOT NULL
             AND source_system IS NOT NULL AND amount IS NOT NULL AND status IS NOT NULL
             AND version IS NOT NULL AND checksum IS NOT NULL) AS nulls_ok
        FROM {src}""",
    )
    return w.add(
        name,
        f"""SELECT *, {tax('amount_dec')} AS total_tax,
            coalesce(nulls_ok AND date_diff('second', event_ts, {AS_OF}) > 86400, FALSE) AS stale,
            coalesce(checksum = md5(event_id || '|' || customer_id || '|' ||
                CASE WHEN amount_dec = round(amount_dec, 2) THEN CAST(CAST(amount_dec AS DECIMAL(30,2)) AS VARCHAR)
                     ELSE amount END || '|' || event_time), FALSE) AS checksum_ok,
            CASE WHEN NOT nulls_ok THEN 'nulls' WHEN event_ts IS NULL THEN 'malformed'
                 WHEN amount_num IS NULL OR version_num IS NULL THEN 'type_mismatches'
                 ELSE 'stored' END AS outcome
        FROM {name}0""",
    )


def metrics(w: With, src: str, by: Sequence[str] = (), source: str | None = None) -> str:
    """Names the step that holds the checked flow's metrics."""
    ann = annotated(w, src)
    c, against = comma(by), source or src
    w.add(
        "tot",
        f"""SELECT {c}CAST(count(*) AS BIGINT) AS ingested, CAST(0 AS BIGINT) AS invalid_schema,
            CAST(count_if(outcome = 'nulls') AS BIGINT) AS nulls,
            CAST(count_if(stale) AS BIGINT) AS freshness_issues,
            CAST(count_if(outcome = 'type_mismatches') AS BIGINT) AS type_mismatches,
            CAST(count_if(outcome = 'malformed') AS BIGINT) AS malformed,
            CAST(0 AS BIGINT) AS transformation_failures,
            CAST(count_if(outcome = 'stored') AS BIGINT) AS stored,
            CAST(count_if(outcome = 'stored' AND NOT checksum_ok) AS BIGINT) AS checksum_mismatch_rows,
            CAST(count_if(outcome = 'stored') - count(DISTINCT CASE WHEN outcome = 'stored' THEN event_id END)
                AS BIGINT) AS duplicate_rows
        FROM {ann} {group(by)}""",
    )
    w.add(
        "ids",
        f"""SELECT {c}CAST(count_if(s AND NOT t) AS BIGINT) AS missing_ids,
            CAST(count_if(t AND NOT s) AS BIGINT) AS unexpected_ids
        FROM (SELECT {c}event_id, bool_or(s) AS s, bool_or(t) AS t FROM (
                SELECT {c}event_id, TRUE AS s, FALSE AS t FROM {against} UNION ALL
                SELECT {c}event_id, FALSE, TRUE FROM {ann} WHERE outcome = 'stored')
              GROUP BY {c}event_id) {group(by)}""",
    )
    w.add("src_n", f"SELECT {c}CAST(count(*) AS BIGINT) AS compared_source_rows FROM {against} {group(by)}")
    w.add(
        "pos_s",
        f"SELECT {c}row_number() OVER ({partition(by)} ORDER BY seq) AS pos, event_time AS st FROM {against}",
    )
    w.add(
        "pos_t",
        f"""SELECT {c}row_number() OVER ({partition(by)} ORDER BY seq) AS pos, event_time AS tt
        FROM {ann} WHERE outcome = 'stored'""",
    )
    w.add(
        "ord",
        f"""SELECT {c}CAST(count_if(st IS NULL OR st <> tt) AS BIGINT) AS order_mismatches
        FROM pos_t LEFT JOIN pos_s USING ({c}pos) {group(by)}""",
    )
    return w.add(
        "met",
        f"""SELECT {c}ingested, invalid_schema, nulls, freshness_issues, type_mismatches, malformed,
            transformation_failures, CAST(duplicate_rows > 0 AS BIGINT) AS mapping_issues, stored,
            CAST(0 AS BIGINT) AS row_count_mismatch,
            CAST(checksum_mismatch_rows > 0 AS BIGINT) AS checksum_mismatch,
            missing_ids = 0 AND unexpected_ids = 0 AS downstream_reconciliation,
            CAST(coalesce(order_mismatches, 0) AS DOUBLE) / CAST(greatest(1, compared_source_rows) AS DOUBLE)
                AS out_of_order,
            ingested AS source_count, stored AS stored_rows, stored AS proposed_stored_rows,
            nulls + type_mismatches + CAST(checksum_mismatch_rows > 0 AS BIGINT) AS proposed_detected_issues,
            duplicate_rows, checksum_mismatch_rows, missing_ids, unexpected_ids,
            coalesce(order_mismatches, 0) AS order_mismatches, compared_source_rows
        FROM tot JOIN ids {using(by)} JOIN src_n {using(by)} LEFT JOIN ord {using(by)}""",
    )


def matches(w: With, by: Sequence[str], names: Sequence[str] = NAMES) -> str:
    """Names the step with true and false positives and negatives per category."""
    faulted, sources = all_scenarios(w, names), all_sources(w, names)
    ann = annotated(w, faulted)
    k, p = ", ".join(by), partition(by)
    w.add(
        "facts",
        f"""SELECT {k}, event_id, min(s) AS s, min(r) AS r FROM (
            SELECT {k}, event_id, seq AS s, NULL AS r FROM {sources} UNION ALL
            SELECT {k}, event_id, NULL, seq FROM {faulted}) GROUP BY {k}, event_id""",
    )
    w.add(
        "ranked",
        f"""SELECT *, row_number() OVER ({p} ORDER BY s) AS rs, row_number() OVER ({p} ORDER BY r) AS rr
        FROM facts WHERE s IS NOT NULL AND r IS NOT NULL""",
    )
    w.add(
        "found",
        f"""SELECT {k}, event_id, seq, CASE outcome WHEN 'stored' THEN 'corruption' ELSE 'schema_drift' END AS category
            FROM {ann} WHERE outcome <> 'stored' OR NOT checksum_ok
        UNION ALL
        SELECT {k}, event_id, f.seq, 'duplication' FROM {faulted} f JOIN facts USING ({k}, event_id)
            WHERE f.seq <> facts.r
        UNION ALL SELECT {k}, event_id, s, 'loss' FROM facts WHERE r IS NULL
        UNION ALL SELECT {k}, event_id, r, 'inconsistency' FROM ranked WHERE rs <> rr""",
    )
    w.add(
        "injected",
        f"""SELECT {k}, event_id, seq, unnest(list_distinct(faults)) AS category FROM {faulted}
        UNION ALL SELECT {k}, event_id, seq, 'loss' FROM {sources}
        WHERE (scenario = 'dropped' AND {sampled('drop', 'seq', 0.2)})
           OR (scenario = 'mixed' AND {sampled('drop', 'seq', 0.1)})""",
    )
    return w.add(
        "matched",
        f"""SELECT {k}, category, CAST(count_if(f AND t) AS BIGINT) AS true_positives,
            CAST(count_if(f AND NOT t) AS BIGINT) AS false_positives,
            CAST(count_if(t AND NOT f) AS BIGINT) AS false_negatives
        FROM (SELECT {k}, event_id, seq, category, bool_or(f) AS f, bool_or(t) AS t FROM (
                SELECT *, TRUE AS f, FALSE AS t FROM found UNION ALL
                SELECT *, FALSE, TRUE FROM injected) GROUP BY {k}, event_id, seq, category)
        GROUP BY {k}, category""",
    )


def scores(w: With, by: Sequence[str]) -> str:
    matches(w, by)
    k = ", ".join(by)

    def found(alias: str, *categories: str) -> str:
        listed = ", ".join(f"'{c}'" for c in categories)
        return (
            f"CAST(coalesce(sum(CASE WHEN category IN ({listed}) THEN true_positives + false_positives END), 0)"
            f" AS BIGINT) AS {alias}"
        )

    w.add("groups", f"SELECT DISTINCT {k} FROM sources")
    w.add(
        "counted",
        f"""SELECT {k}, CAST(coalesce(sum(true_positives), 0) AS BIGINT) AS true_positives,
            CAST(coalesce(sum(false_positives), 0) AS BIGINT) AS false_positives,
            CAST(coalesce(sum(false_negatives), 0) AS BIGINT) AS false_negatives,
            {found('detected_loss', 'loss')}, {found('detected_duplicates', 'duplication')},
            {found('detected_corruption', 'corruption', 'schema_drift')},
            {found('detected_inconsistency', 'inconsistency')}
        FROM groups LEFT JOIN matched USING ({k}) GROUP BY {k}""",
    )
    w.add(
        "rated",
        """SELECT *,
            CASE WHEN true_positives + false_positives = 0 THEN 1.0::DOUBLE
                 ELSE true_positives::DOUBLE / (true_positives + false_positives)::DOUBLE END AS "precision",
            CASE WHEN true_positives + false_negatives = 0 THEN 1.0::DOUBLE
                 ELSE true_positives::DOUBLE / (true_positives + false_negatives)::DOUBLE END AS recall
        FROM counted""",
    )
    return w.add(
        "scored",
        """SELECT *, CASE WHEN "precision" + recall = 0 THEN 0.0::DOUBLE
                ELSE 2 * "precision" * recall / ("precision" + recall) END AS f1,
            CASE WHEN true_positives + false_negatives = 0 THEN 1.0::DOUBLE ELSE
                (true_positives + false_positives)::DOUBLE / (true_positives + false_negatives)::DOUBLE END
                AS detection_accuracy FROM rated""",
    )


def stage_checks(w: With, by: Sequence[str], names: Sequence[str] = NAMES) -> str:
    faulted, sources = all_scenarios(w, names), all_sources(w, names)
    metrics(w, faulted, by, sources)
    k = ", ".join(by)
    digest = f"('0x' || substr({row_digest(PAYLOAD)}, 1, 8))::BIGINT"
    w.add("fp_s", f"SELECT {k}, sum({digest}) AS fs FROM {sources} GROUP BY {k}")
    w.add("fp_t", f"SELECT {k}, sum({digest}) AS ft FROM ann WHERE outcome = 'stored' GROUP BY {k}")
    # The tax of the amount before the faults; a copy has its original's.
    w.add("tax_s", f"SELECT {k}, event_id, any_value({tax('CAST(amount AS DECIMAL(30,10))')}) AS st FROM {sources} GROUP BY {k}, event_id")
    w.add(
        "tax_n",
        f"""SELECT {k}, count_if(total_tax IS DISTINCT FROM st) AS wrong_tax
        FROM ann JOIN tax_s USING ({k}, event_id) WHERE outcome = 'stored' GROUP BY {k}""",
    )
    w.add(
        "rank_n",
        f"""SELECT {k}, count_if(rs <> rr) AS displaced FROM (
            SELECT {k}, row_number() OVER ({partition(by)} ORDER BY s) AS rs, row_number() OVER ({partition(by)} ORDER BY r) AS rr
            FROM (SELECT {k}, event_id, min(seq) AS s FROM {sources} GROUP BY {k}, event_id)
            JOIN (SELECT {k}, event_id, min(seq) AS r FROM ann WHERE outcome = 'stored' GROUP BY {k}, event_id)
            USING ({k}, event_id)) GROUP BY {k}""",
    )
    w.add(
        "cust_n",
        f"""SELECT {k}, count_if(t IS NULL) AS without_events FROM (SELECT DISTINCT {k}, customer_id FROM {sources})
        LEFT JOIN (SELECT DISTINCT {k}, customer_id, TRUE AS t FROM ann WHERE outcome = 'stored') USING ({k}, customer_id)
        GROUP BY {k}""",
    )
    w.add(
        "met_fp",
        f"""SELECT *, fs IS DISTINCT FROM ft AS differs FROM met JOIN fp_s USING ({k}) LEFT JOIN fp_t USING ({k})
        JOIN tax_n USING ({k}) JOIN rank_n USING ({k}) JOIN cust_n USING ({k})""",
    )
    rows = [
        ("Ingestion", "schema_validation", "schema_drift,null_values", "invalid_schema"),
        ("Ingestion", "null_check", "schema_drift,null_values", "nulls"),
        ("Preprocessing", "duplicate_detection", "duplication,schema_drift", "duplicate_rows"),
        ("Preprocessing", "checksum_validate", "duplication,schema_drift", "checksum_mismatch_rows"),
        ("Transformation", "assertion_check", "incorrect_transformation", "wrong_tax"),
        ("Transformation", "type_validation", "incorrect_transformation", "type_mismatches + malformed"),
        ("Storage", "row_count_check", "data_loss,inconsistency", "abs(compared_source_rows - stored)"),
        ("Storage", "checksum_reconcile", "data_loss,inconsistency", "CAST(differs AS BIGINT)"),
        ("Output", "downstream_validation", "inconsistency,corruption", "missing_ids + unexpected_ids + displaced"),
        ("Output", "consistency_check", "inconsistency,corruption", "without_events"),
    ]
    return w.add(
        "checked",
        " UNION ALL ".join(
            f"""SELECT {k}, '{stage}' AS stage_name, '{check}' AS check_name, '{issues}' AS issue_type,
            CAST({count} AS BIGINT) AS findings_count, ({count}) = 0 AS passed FROM met_fp"""
            for stage, check, issues, count in rows
        ),
    )


def ab(w: With) -> str:
    return w.add(
        "ab",
        f"""SELECT o_orderkey AS id, {between('a42', 'o_orderkey', 1, 100)} AS a,
            {between('b42', 'o_orderkey', 1, 100)} AS b FROM orders""",
    )


def ab_fault(w: With, kind: str) -> str:
    src = ab(w)
    k = f"(SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM {src})"
    if kind == "data_loss":
        return w.add(
            "ab_loss",
            f"""SELECT id, a, b FROM (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM {src})
            WHERE rn <= (SELECT count(*) FROM {src}) - {k}""",
        )
    if kind == "duplication":
        return w.add(
            "ab_dup",
            f"""SELECT * FROM {src} UNION ALL
            SELECT t.id, t.a, t.b
            FROM (SELECT {h60('exactdup', 'pos')} % (SELECT count(*) FROM {src}) AS pos
                  FROM (SELECT unnest(range({k})) AS pos)) d
            JOIN (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM {src}) t USING (pos)""",
        )
    if kind == "corruption":
        hit = f"id IN (SELECT id FROM {src} ORDER BY {h32('exactcorrupt', 'id')}, id LIMIT {k})"
        field = bucket("field", "id", 2)
        return w.add(
            "ab_corrupt",
            f"""SELECT id, CASE WHEN {hit} AND {field} = 0 THEN a * 2 ELSE a END AS a,
                CASE WHEN {hit} AND {field} = 1 THEN b * 2 ELSE b END AS b FROM {src}""",
        )
    hit = f"id IN (SELECT id FROM {src} ORDER BY {h32('negative', 'id')}, id LIMIT {k})"
    return w.add("ab_negative", f"SELECT CASE WHEN {hit} THEN -1 ELSE id END AS id, a, b FROM {src}")


def tampered(w: With) -> str:
    src = ab(w)
    return w.add(
        "tampered",
        f"SELECT *, a + b + CASE WHEN {sampled('wrongtotal', 'id', 0.05)} THEN 1 ELSE 0 END AS total FROM {src}",
    )


def nulled(w: With) -> str:
    src = events(w)
    return w.add(
        "nulled",
        f"""SELECT * REPLACE (
            CASE WHEN NOT {sampled('nullcust', 'seq', 0.03)} THEN customer_id END AS customer_id,
            CASE WHEN NOT {sampled('nullstat', 'seq', 0.02)} THEN status END AS status) FROM {src}""",
    )


def generated(w: With) -> str:
    w.add(
        "gen0",
        f"""SELECT o_orderkey AS seq, printf('order-%06d', o_orderkey) AS event_id,
            strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(o_orderkey * 10), '%Y-%m-%dT%H:%M:%S') AS event_time,
            printf('cust-%03d', {between('customer42', 'o_orderkey', 1, 100)}) AS customer_id,
            'web' AS source_system,
            CAST(CAST(CAST({between('amount42', 'o_orderkey', 1000, 50000)} AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2))
                AS VARCHAR) AS amount,
            ['created', 'paid', 'shipped'][{between('status42', 'o_orderkey', 1, 3)}] AS status,
            '1' AS version FROM orders""",
    )
    return w.add("gen", f"SELECT *, {CHECKSUM} AS checksum FROM gen0")


# --- Statements -----------------------------------------------------------------

_EVENTS_OUT = f"SELECT {EVENT_COLUMNS}, array_to_string(faults, ',') AS faults FROM"
_RUN = "CAST((list_position([" + ", ".join(f"'{n}'" for n in NAMES) + "], scenario) - 1) * 5 + dataset AS BIGINT)"
_GROUPS = ("scenario", "dataset")


def _sources(out: dict[str, str]) -> None:
    types = [
        ("o_orderkey", "bigint"),
        ("o_custkey", "bigint"),
        ("o_orderstatus", "string"),
        ("o_totalprice", "double"),
        ("o_orderdate", "timestamp_ntz"),
        ("o_orderpriority", "string"),
    ]
    out["schema_profile"] = " UNION ALL ".join(
        f"""SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS "column", '{t}' AS type,
        count(*) AS rows, count({c}) AS non_null FROM orders"""
        for i, (c, t) in enumerate(types)
    )
    w = With()
    src = nulled(w)
    out["null_profile"] = w.select(
        " UNION ALL ".join(
            f"SELECT '{c}' AS field, CAST(count_if({c} IS NULL) AS BIGINT) AS nulls FROM {src}"
            for c in EVENT_COLUMNS.split(", ")
            if c != "seq"
        )
    )
    tail = "CAST(0 AS BIGINT) AS blank_lines, CAST(0 AS BIGINT) AS malformed_lines FROM lineitem"
    out["read_accounting"] = f"""SELECT count(*) AS total_rows, count(*) AS rows_processed,
        'full' AS processing_mode, FALSE AS truncated, {tail}"""
    out["ndjson_bad_lines"] = f"""SELECT CAST(count_if(trim(value) <> '' AND json_valid(value)) AS BIGINT) AS valid_rows,
        CAST(count_if(trim(value) = '') AS BIGINT) AS blank_lines,
        CAST(count_if(trim(value) <> '' AND NOT json_valid(value)) AS BIGINT) AS malformed_lines
        FROM (SELECT CASE WHEN {sampled('badjson', 'event_id', 0.01)} THEN '{{bad'
            WHEN {sampled('blank', 'event_id', 0.005)} THEN '  ' ELSE props END AS value FROM events)"""
    out["preview_sanitized"] = """SELECT event_id,
        CASE WHEN event_id % 3 IN (0, 1) THEN NULL ELSE value END AS value
        FROM events ORDER BY event_id LIMIT 5"""
    w = With()
    ann = annotated(w, inject(w, "schema_drift", events(w)))
    out["stored_row_count"] = w.select(
        f"""SELECT CAST(count_if(outcome = 'stored') AS BIGINT) AS stored_rows,
        CAST(count_if(outcome = 'stored') AS BIGINT) AS offered_rows, FALSE AS row_count_mismatch FROM {ann}"""
    )


def _formats(out: dict[str, str]) -> None:
    text = "' says \"hi\",' || chr(10) || 'then' || chr(10) || chr(10) || 'leaves'"
    out["parsed_formats"] = f"""SELECT format, count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS keys,
            CAST(sum(length(c_name) + CASE WHEN c_custkey % 3 = 0 THEN length({text}) ELSE 0 END) AS BIGINT) AS characters,
            count_if(c_custkey % 3 = 0) AS quoted, CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS balance,
            count(*) AS total_rows, CASE format WHEN 'ndjson' THEN count_if(c_custkey % 7 = 0) ELSE 0 END AS malformed_lines
        FROM customer, (SELECT unnest(['csv', 'tsv', 'json', 'ndjson']) AS format) GROUP BY format"""


def _faults(out: dict[str, str]) -> None:
    w = With()
    src = generated(w)
    out["generate_orders"] = w.select(f"SELECT * FROM {src}")
    out["generate_ab"] = f"""SELECT o_orderkey AS id, {between('a42', 'o_orderkey', 1, 100)} AS a,
        {between('b42', 'o_orderkey', 1, 100)} AS b FROM orders"""
    makers = {
        "fault_missing": missing,
        "fault_duplicates": duplicates,
        "fault_corruption": corruption,
        "fault_schema_drift": drift,
        "fault_out_of_order": out_of_order,
    }
    for name, make in makers.items():
        w = With()
        src = make(w, events(w), 0.1, "faulted")
        out[name] = w.select(f"{_EVENTS_OUT} {src}")
    for name, kind in (
        ("fault_tail_loss", "data_loss"),
        ("fault_exact_dup", "duplication"),
        ("fault_exact_corrupt", "corruption"),
        ("fault_negative_id", "inconsistency"),
    ):
        w = With()
        src = ab_fault(w, kind)
        out[name] = w.select(f"SELECT id, a, b FROM {src}")
    w = With()
    src = inject(w, "mixed", events(w))
    out["scenario_mixed"] = w.select(f"{_EVENTS_OUT} {src}")


def _row_checks(out: dict[str, str]) -> None:
    part = bucket("keys", "event_id")
    document = f"""(SELECT CASE WHEN {part} < 500 THEN '{{}}' WHEN {part} < 1000 THEN '{{"k": null}}'
        ELSE props END AS d FROM events)"""
    out["schema_validation"] = f"""SELECT count(*) AS rows,
        CAST(count_if(NOT json_exists(d, '$.k')) AS BIGINT) AS invalid_schema,
        CAST(count_if(json_exists(d, '$.k') AND json_extract_string(d, '$.k') IS NULL) AS BIGINT) AS nulls
        FROM {document}"""
    w = With()
    src = nulled(w)
    out["null_check"] = w.select(
        f"""SELECT count(*) AS rows, CAST(count_if(customer_id IS NULL OR status IS NULL) AS BIGINT) AS rows_with_nulls
        FROM {src}"""
    )
    w = With()
    src = events(w)
    out["freshness"] = w.select(
        f"""SELECT count(*) AS rows, CAST(count_if(date_diff('second', CAST(event_time AS TIMESTAMP), {AS_OF}) > 86400)
        AS BIGINT) AS freshness_issues FROM {src}"""
    )
    w = With()
    ann = annotated(w, inject(w, "schema_drift", events(w)))
    out["enforce_types"] = w.select(
        f"SELECT event_id, amount_num AS amount, version_num AS version FROM {ann} WHERE outcome = 'stored'"
    )
    out["type_rejects"] = w.select(
        f"SELECT seq, event_id, amount, version FROM {ann} WHERE outcome = 'type_mismatches'"
    )
    out["baseline_transform"] = w.select(
        f"""SELECT event_id, event_time, customer_id, source_system, coalesce(amount_num, 0.0) AS amount, status,
        version_num AS version, checksum, coalesce({tax('amount_dec')}, 0.0) AS total_tax FROM {ann}"""
    )
    w = With()
    src = nulled(w)
    drifted = drift(w, src, 0.2, "drifted")
    out["validate_data_types"] = w.select(
        f"""SELECT CAST(0 AS BIGINT) AS event_id_violations,
        CAST(count_if(customer_id IS NULL) AS BIGINT) AS customer_id_violations,
        CAST(count_if(amount = 'N/A') AS BIGINT) AS amount_violations, CAST(0 AS BIGINT) AS version_violations,
        CAST(count_if(customer_id IS NULL) + count_if(amount = 'N/A') AS BIGINT) AS violations FROM {drifted}"""
    )
    w = With()
    ann = annotated(w, nulled(w))
    out["ingestion_metrics"] = w.select(
        f"""SELECT count(*) AS ingested, CAST(0 AS BIGINT) AS invalid_schema,
        CAST(count_if(NOT nulls_ok) AS BIGINT) AS nulls, CAST(count_if(stale) AS BIGINT) AS freshness_issues FROM {ann}"""
    )
    late = bucket("badtime", "seq")
    w = With()
    src = events(w)
    out["malformed_event_time"] = w.select(
        f"SELECT count(*) AS rows, CAST(count_if({late} < 200) AS BIGINT) AS malformed FROM {src}"
    )
    out["transform_tax"] = w.select(
        f"""SELECT event_id, CAST(amount AS DOUBLE) AS amount, {tax('CAST(amount AS DECIMAL(18,2))')} AS total_tax
        FROM {src}"""
    )
    w = With()
    src = events(w)
    # Tax from whole thousandths, so that it does not depend on how decimals are rounded.
    out["exact_amounts"] = w.select(
        f"""SELECT event_id, CAST(((CAST(CAST(amount AS DECIMAL(18,2)) * 1000 AS BIGINT)
                + CASE WHEN seq % 7 = 0 THEN 5 ELSE 0 END + 50) // 100) AS DOUBLE) / 100 AS total_tax,
            seq % 7 <> 0 AS checksum_ok FROM {src}"""
    )
    out["json_value_types"] = """SELECT CAST(count_if(wrong) AS BIGINT) AS k_violations, CAST(count_if(wrong) AS BIGINT) AS violations
        FROM (SELECT CASE WHEN event_type <> 'error' AND event_id % 10 = 7 THEN TRUE
                WHEN event_type <> 'error' AND event_id % 10 = 8 THEN FALSE
                WHEN event_type = 'error' OR event_id % 10 = 3 THEN TRUE
                ELSE NOT regexp_matches(props, '^\\{"k": -?[0-9]+\\}$') END AS wrong FROM events)"""
    w = With()
    src = ab(w)
    out["transform_sum"] = w.select(f"SELECT *, a + b AS total FROM {src}")


def _integrity(out: dict[str, str]) -> None:
    w = With()
    src = events(w)
    out["event_checksum"] = w.select(f"SELECT event_id, checksum FROM {src}")
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    out["row_checksum"] = f"SELECT {', '.join(columns)}, {row_digest(columns)} AS row_checksum FROM lineitem"
    w = With()
    ann = annotated(w, inject(w, "corrupted", events(w)))
    out["checksum_mismatch"] = w.select(
        f"""SELECT count(*) AS rows, CAST(count_if(NOT checksum_ok) AS BIGINT) AS mismatch_rows,
        CAST(count_if(NOT checksum_ok) > 0 AS BIGINT) AS checksum_mismatch FROM {ann}"""
    )
    w = With()
    src = events(w)
    digest = f"('0x' || substr({row_digest(PAYLOAD)}, 1, 8))::BIGINT"
    sides = [("source", src), ("duplicated", inject(w, "duplicated")), ("corrupted", inject(w, "corrupted"))]
    out["table_fingerprint"] = w.select(
        " UNION ALL ".join(
            f"SELECT '{n}' AS side, count(*) AS row_count, CAST(sum({digest}) AS VARCHAR) AS fingerprint FROM {f}"
            for n, f in sides
        )
    )
    w = With()
    src = inject(w, "duplicated", events(w))
    out["duplicate_flag"] = w.select(f'SELECT count(*) = count(DISTINCT event_id) AS "unique" FROM {src}')
    out["duplicate_count"] = w.select(
        f"""SELECT count(*) - count(DISTINCT event_id) AS surplus_rows,
        (SELECT count(*) FROM (SELECT event_id FROM {src} GROUP BY event_id HAVING count(*) > 1)) AS repeated_keys
        FROM {src}"""
    )
    w = With()
    src = inject(w, "mixed", events(w))
    ranked = w.add(
        "dup_rank",
        f"""SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CAST(version AS INT) DESC, seq) AS rn
        FROM {src}""",
    )
    out["duplicate_rows"] = w.select(f"SELECT seq, event_id FROM {ranked} WHERE rn > 1")
    out["dedupe_keep_first"] = w.select(f"{_EVENTS_OUT} {ranked} WHERE rn = 1")

    def summary(table: str, key: str) -> str:
        return f"""SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows,
            CAST(count_if(n > 1) AS BIGINT) AS repeated_keys, count_if(n > 1) = 0 AS "unique"
            FROM (SELECT count(*) AS n FROM {table} GROUP BY {key})"""

    out["redelivered_rows"] = """WITH once AS (
            SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 4 THEN l_orderkey * 8 + l_linenumber END AS seq
            FROM lineitem
        ), rows_in AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE l_linenumber < 3)
        SELECT l_orderkey, l_linenumber, seq FROM (
            SELECT *, row_number() OVER (PARTITION BY l_orderkey
                ORDER BY CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber % 3 END DESC NULLS LAST, seq NULLS LAST, l_linenumber) AS rn
            FROM rows_in) WHERE rn > 1"""
    out["real_world_lineitem_keys"] = summary("lineitem", "l_orderkey, l_linenumber")
    out["real_world_doc_text"] = summary("documents", "text")
    w = With()
    src = tampered(w)
    out["transform_correctness"] = w.select(
        f"SELECT count(*) AS compared, CAST(count_if(total <> a + b) AS BIGINT) AS errors FROM {src}"
    )
    out["sum_integrity"] = w.select(
        f"SELECT count(*) AS rows, CAST(count_if(total <> a + b) AS BIGINT) AS integrity_errors FROM {src}"
    )
    rules = [
        f"SELECT 'broken_sum' AS rule, count(*) AS violations FROM {src} WHERE total <> a + b",
        f"SELECT 'a_above_90', count(*) FROM {src} WHERE a > 90",
        f"SELECT 'equal_terms', count(*) FROM {src} WHERE a = b",
        f"SELECT 'repeated_pair', count(*) FROM (SELECT a, b FROM {src} GROUP BY a, b HAVING count(*) > 1)",
    ]
    out["rule_violations"] = w.select(" UNION ALL ".join(rules))
    w = With()
    src = ab_fault(w, "inconsistency")
    out["negative_id"] = w.select(
        f"SELECT count(*) AS rows, CAST(count_if(id < 0) AS BIGINT) AS negative_ids FROM {src}"
    )


def _reconcile(out: dict[str, str]) -> None:
    w = With()
    src = events(w)
    got = inject(w, "mixed")
    out["reconcile_ids"] = w.select(
        f"""SELECT missing, CAST(0 AS BIGINT) AS unexpected, missing = 0 AS reconciled FROM (
        SELECT count(*) AS missing FROM {src} WHERE event_id NOT IN (SELECT event_id FROM {got}))"""
    )
    out["missing_ids"] = f"""SELECT id FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS id)
        WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE NOT {sampled('drop', 'o_orderkey', 0.2)})"""
    out["missing_intervals"] = f"""WITH ids AS (SELECT o_orderkey AS id FROM orders WHERE NOT {sampled('drop', 'o_orderkey', 0.2)}
            UNION ALL SELECT -1 UNION ALL SELECT max(o_orderkey) + 5 FROM orders),
        steps AS (SELECT id, lag(id) OVER (ORDER BY id) AS before FROM ids)
        SELECT before + 1 AS first, id - 1 AS last, id - before - 1 AS ids FROM steps WHERE id - before > 1"""
    w = With()
    src = events(w)
    w.add(
        "tampered",
        f"""SELECT * REPLACE (CASE WHEN {sampled('changed', 'seq', 0.002)} THEN '1.00' ELSE amount END AS amount,
            CASE WHEN {sampled('renamed', 'seq', 0.001)} THEN event_id || 'x' ELSE event_id END AS event_id)
        FROM (SELECT * FROM {src} UNION ALL SELECT * FROM {src} WHERE {sampled('again', 'seq', 0.001)})
        WHERE NOT {sampled('gone', 'seq', 0.002)}""",
    )
    row = "event_id, customer_id, amount, event_time, status"
    w.add(
        "both_sides",
        f"""SELECT event_id, max(s <> t) AS differ, sum(s) AS source_rows, sum(t) AS target_rows FROM (
            SELECT {row}, count_if(side = 's') AS s, count_if(side = 't') AS t FROM (
                SELECT {row}, 's' AS side FROM {src} UNION ALL SELECT {row}, 't' FROM tampered) GROUP BY {row})
        GROUP BY event_id""",
    )
    out["digest_differences"] = w.select(
        """SELECT event_id, CASE WHEN target_rows = 0 THEN 'missing' WHEN source_rows = 0 THEN 'unexpected' ELSE 'changed' END
            AS status, CAST(source_rows AS BIGINT) AS source_rows, CAST(target_rows AS BIGINT) AS target_rows
        FROM both_sides WHERE differ"""
    )
    out["sketch_differences"] = f"""WITH got AS (
            SELECT CASE WHEN {sampled('renamed', 'o_orderkey', 0.001)} THEN -o_orderkey - 1 ELSE o_orderkey END AS id FROM orders
            WHERE NOT {sampled('gone', 'o_orderkey', 0.002)})
        SELECT o_orderkey AS id, 'missing' AS side FROM orders WHERE o_orderkey NOT IN (SELECT id FROM got)
        UNION ALL SELECT id, 'unexpected' FROM got WHERE id NOT IN (SELECT o_orderkey FROM orders)"""
    w = With()
    moved = inject(w, "out_of_order", events(w))
    out["arrival_inversions"] = w.select(
        f"""SELECT customer_id, rows, coalesce(pairs, 0) AS inversions FROM (
            SELECT customer_id, count(*) AS rows FROM {moved} GROUP BY customer_id) LEFT JOIN (
            SELECT a.customer_id, count(*) AS pairs FROM {moved} a JOIN {moved} b
            ON a.customer_id = b.customer_id AND a.seq < b.seq AND a.event_time > b.event_time GROUP BY a.customer_id)
        USING (customer_id)"""
    )
    w = With()
    src = events(w)
    ann = annotated(w, inject(w, "schema_drift"))
    out["accounted_write"] = w.select(
        f"""SELECT count(*) AS written_rows, count(*) AS stored_rows, true AS complete FROM {ann} WHERE outcome = 'stored'"""
    )
    rules = {
        "line_is_key": ("l_orderkey, l_linenumber", "n > 1"),
        "part_once_an_order": ("l_orderkey, l_partkey", "n > 1"),
        "line_decides_part_and_price": (
            "l_orderkey, l_linenumber",
            "count(DISTINCT l_partkey) > 1 OR count(DISTINCT l_extendedprice) > 1",
        ),
        "part_decides_supplier": ("l_partkey", "count(DISTINCT l_suppkey) > 1"),
        "order_decides_shipdate": ("l_orderkey", "count(DISTINCT l_shipdate) > 1"),
        "status_decides_flag": ("l_linestatus", "count(DISTINCT l_returnflag) > 1"),
    }
    out["group_rule_violations"] = " UNION ALL ".join(
        f"""SELECT '{name}' AS rule, count(*) AS groups, count_if(bad) AS violating_groups,
            CAST(coalesce(sum(CASE WHEN bad THEN n END), 0) AS BIGINT) AS violating_rows
        FROM (SELECT count(*) AS n, {bad} AS bad FROM lineitem GROUP BY {by})"""
        for name, (by, bad) in rules.items()
    )
    out["mixed_json_profile"] = """WITH docs AS (SELECT CASE event_id % 50
            WHEN 0 THEN '{"k": "' || event_type || '", "o": {"a": 1.5, "b": [1, "{t[", null]}}'
            WHEN 1 THEN '[' || props || ', {"k": true}]' WHEN 2 THEN '{"k": ' WHEN 3 THEN NULL ELSE props END AS doc FROM events),
        found AS (
            SELECT regexp_replace(replace(t.fullkey, '"', ''), '\\[[0-9]+\\]', '[*]', 'g') AS path,
                CASE WHEN t.type IN ('BIGINT', 'UBIGINT') THEN 'integer' WHEN t.type = 'DOUBLE' THEN 'number'
                    WHEN t.type = 'VARCHAR' THEN 'string' ELSE lower(t.type) END AS type
            FROM (SELECT doc FROM docs WHERE json_valid(doc)) d, json_tree(CAST(d.doc AS JSON)) t
            UNION ALL SELECT '$', CASE WHEN doc IS NULL THEN 'absent' ELSE 'malformed' END FROM docs
            WHERE doc IS NULL OR NOT json_valid(doc))
        SELECT path, type, count(*) AS "values",
            sum(CASE WHEN type IN ('null', 'malformed', 'absent') THEN 0 ELSE 1 END) OVER (PARTITION BY path) > 1 AS mixed
        FROM found GROUP BY path, type"""
    out["row_count_reconcile"] = w.select(
        f"""SELECT status, source_rows, target_rows, target_rows - source_rows AS difference,
            source_rows = target_rows AS matches
        FROM (SELECT status, count(*) AS source_rows FROM {src} GROUP BY status)
        JOIN (SELECT status, count(*) AS target_rows FROM {ann} WHERE outcome = 'stored' GROUP BY status)
        USING (status)"""
    )
    w = With()
    src = events(w)
    metrics(w, inject(w, "schema_drift"), (), src)
    out["positional_mismatch_rate"] = w.select(
        """SELECT order_mismatches AS mismatches, compared_source_rows AS source_rows, out_of_order AS mismatch_rate
        FROM met"""
    )
    w = With()
    events(w)
    metrics(w, inject(w, "mixed"), (), "ev")
    out["downstream_validation"] = w.select(
        """SELECT downstream_reconciliation AS reconciled, missing_ids AS missing, unexpected_ids AS unexpected,
        order_mismatches AS mismatches, out_of_order FROM met"""
    )
    w = With()
    src = inject(w, "out_of_order", events(w))
    out["arrival_disorder"] = w.select(
        f"""SELECT customer_id, count(*) AS rows, CAST(count_if(coalesce(prev > event_time, FALSE)) AS BIGINT) AS out_of_order
        FROM (SELECT *, lag(event_time) OVER (PARTITION BY customer_id ORDER BY seq) AS prev FROM {src})
        GROUP BY customer_id"""
    )
    w = With()
    src = w.add("gen_f", f"SELECT *, {NO_FAULTS} AS faults FROM {generated(w)}")
    moved = out_of_order(w, src, 0.2, "moved")
    out["arrival_disorder_overall"] = w.select(
        f"""SELECT count(*) AS rows, CAST(count_if(coalesce(prev > event_time, FALSE)) AS BIGINT) AS out_of_order
        FROM (SELECT *, lag(event_time) OVER (ORDER BY seq) AS prev FROM {moved})"""
    )
    out["consistency_orders_lineitem"] = """SELECT childless AS parents_without_children, orphans AS orphan_rows,
        childless = 0 AND orphans = 0 AS consistent
        FROM (SELECT count(*) AS childless FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
        JOIN (SELECT count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) ON TRUE"""


def _flows(out: dict[str, str]) -> None:
    w = With()
    src = inject(w, "mixed", events(w))
    dec = number("amount", "DECIMAL(30,10)")
    out["baseline_batch"] = w.select(
        f"""SELECT count(*) AS record_count, CAST(sum(CAST(coalesce({dec}, 0) AS DECIMAL(28,2))) AS DOUBLE) AS amount_sum,
        CAST(sum(CAST({tax(f'coalesce({dec}, 0)')} AS DECIMAL(28,2))) AS DOUBLE) AS total_tax_sum FROM {src}"""
    )
    for name in NAMES:
        w = With()
        metrics(w, inject(w, name, events(w)))
        out[f"proposed_{name}"] = w.select("SELECT * FROM met")
    w = With()
    metrics(w, inject(w, "mixed", events(w)), (), "ev")
    out["proposed_against_source"] = w.select("SELECT * FROM met")
    w = With()
    events(w)
    metrics(w, all_scenarios(w), ("scenario",))
    out["detected_issues"] = w.select("SELECT scenario, proposed_detected_issues, duplicate_rows FROM met")
    w = With()
    n = f"(SELECT count(*) FROM {ab(w)})"
    out["ab_detections"] = w.select(
        "SELECT *, duplicate_errors + data_loss_errors + inconsistency_errors AS detections FROM ("
        + " UNION ALL ".join(
            f"""SELECT '{kind}' AS fault_type, CAST(0 AS BIGINT) AS transform_errors, CAST(0 AS BIGINT) AS integrity_errors,
            count(*) - count(DISTINCT id) AS duplicate_errors,
            {n} - count(DISTINCT CASE WHEN id >= 0 AND id < {n} THEN id END) AS data_loss_errors,
            CAST(count_if(id < 0) AS BIGINT) AS inconsistency_errors FROM {ab_fault(w, kind)}"""
            for kind in ("duplication", "corruption", "data_loss", "inconsistency")
        )
        + ")"
    )
    w = With()
    events(w)
    src = stage_checks(w, ("scenario",))
    out["stage_check_report"] = w.select(f"SELECT * FROM {src}")
    w = With()
    events(w)
    src = stage_checks(w, ("scenario",), ("mixed",))
    out["stage_check_explode"] = w.select(
        f"""SELECT stage_name, check_name, unnest(string_split(issue_type, ',')) AS issue, findings_count, passed
        FROM {src}"""
    )
    w = With()
    src = inject(w, "mixed", events(w))
    sliced = w.add("sliced", f"SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 20 AS slice FROM {src}")
    metrics(w, sliced, ("slice",))
    counts = (
        "ingested invalid_schema nulls freshness_issues type_mismatches malformed transformation_failures "
        "mapping_issues stored row_count_mismatch checksum_mismatch source_count stored_rows proposed_stored_rows "
        "proposed_detected_issues duplicate_rows checksum_mismatch_rows missing_ids unexpected_ids "
        "order_mismatches compared_source_rows"
    ).split()
    out["microbatch_metrics"] = w.select(
        f"""SELECT count(*) AS batches, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in counts)},
        bool_and(downstream_reconciliation) AS downstream_reconciliation,
        CAST(count_if(downstream_reconciliation) AS BIGINT) AS reconciliation_sum,
        CAST(round(sum(CAST(out_of_order AS DECIMAL(30,12))), 6) AS DOUBLE) AS out_of_order_sum,
        CAST(sum(order_mismatches) AS DOUBLE) / CAST(greatest(1, sum(compared_source_rows)) AS DOUBLE) AS out_of_order
        FROM met"""
    )
    out["stale_by_day"] = f"""SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS rows,
        CAST(count_if(date_diff('microsecond', ts, {EVENTS_AS_OF}) // 1000000 > 86400) AS BIGINT) AS stale_rows
        FROM events GROUP BY 1"""


def _evaluation(out: dict[str, str]) -> None:
    def results(names: Sequence[str]) -> With:
        w = With()
        events(w)
        metrics(w, all_scenarios(w, names), ("scenario",))
        w.add("n", "SELECT CAST(count(*) AS BIGINT) AS n FROM ev")
        w.add(
            "res",
            """SELECT scenario, ingested AS baseline_record_count, source_count AS proposed_source_count,
            stored_rows AS proposed_stored_rows, proposed_detected_issues,
            downstream_reconciliation AS proposed_reconciliation, out_of_order AS proposed_out_of_order_rate,
            CASE WHEN proposed_detected_issues > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "precision",
            proposed_detected_issues::DOUBLE / n::DOUBLE AS recall, CAST(0 AS BIGINT) AS false_positives,
            greatest(0, n - stored_rows) AS false_negatives FROM met JOIN n ON TRUE""",
        )
        return w

    out["scenario_result"] = results(["mixed"]).select("SELECT * FROM res")
    out["scenario_results"] = results(NAMES).select("SELECT * FROM res")
    out["scores_reference"] = results(NAMES).select(
        'SELECT scenario, "precision", recall, false_positives, false_negatives FROM res'
    )
    w = With()
    events(w)
    scores(w, ("scenario",))
    out["scores_true"] = w.select("SELECT * FROM scored")
    out["matches_by_category"] = w.select("SELECT * FROM matched")
    kinds = ("loss", "duplication", "corruption", "schema_drift", "inconsistency")
    out["detected_by_category"] = w.select(
        "SELECT scenario, "
        + ", ".join(f"CAST(count_if(category = '{c}') AS BIGINT) AS {c}" for c in kinds)
        + " FROM found GROUP BY scenario"
    )


def _analytics(out: dict[str, str]) -> None:
    def tables(with_checks: bool = False, with_results: bool = True) -> With:
        w = With()
        events(w)
        if with_results:
            scores(w, _GROUPS)
            w.add(
                "results",
                f"""SELECT {_RUN} AS experiment_run_id, 'proposed' AS pipeline_type, detection_accuracy, "precision",
                    recall, false_positives, false_negatives FROM scored
                UNION ALL SELECT {_RUN}, 'baseline',
                    CASE WHEN true_positives + false_negatives = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE,
                    CASE WHEN true_positives + false_negatives = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END,
                    CAST(0 AS BIGINT), true_positives + false_negatives FROM scored""",
            )
        if with_checks:
            stage_checks(w, _GROUPS)
            plain = (
                ("Ingestion", "basic_schema_read"),
                ("Preprocessing", "optional_type_conversion"),
                ("Transformation", "basic_math"),
                ("Storage", "file_write"),
                ("Output", "manual_review"),
            )
            w.add("run_groups", "SELECT DISTINCT scenario, dataset FROM sources")
            w.add(
                "checks",
                f"""SELECT {_RUN} AS experiment_run_id, 'proposed' AS pipeline_type, stage_name, check_name,
                issue_type, passed, findings_count FROM checked UNION ALL """
                + " UNION ALL ".join(
                    f"SELECT {_RUN}, 'baseline', '{s}', '{c}', '', TRUE, CAST(0 AS BIGINT) FROM run_groups"
                    for s, c in plain
                ),
            )
        all_sources(w)
        w.add(
            "runs",
            f"""SELECT id, dataset AS dataset_id, scenario AS scenario_name,
                TIMESTAMP '2024-01-01 00:00:00' + to_hours(id) AS started_at
            FROM (SELECT DISTINCT {_RUN} AS id, scenario, dataset FROM sources)""",
        )
        if with_results:
            w.add(
                "sides",
                """SELECT r.*, b.detection_accuracy AS ba, b."precision" AS bp, b.recall AS br, b.false_positives AS bfp,
                    b.false_negatives AS bfn, p.detection_accuracy AS pa, p."precision" AS pp, p.recall AS pr,
                    p.false_positives AS pfp, p.false_negatives AS pfn
                FROM runs r JOIN results b ON b.experiment_run_id = r.id AND b.pipeline_type = 'baseline'
                JOIN results p ON p.experiment_run_id = r.id AND p.pipeline_type = 'proposed'""",
            )
        return w

    def avg(value: str, kind: str) -> str:
        hit = f"CASE WHEN pipeline_type = '{kind}' THEN {value} END"
        return f"CAST(sum(CAST({hit} AS DECIMAL(30,12))) AS DOUBLE) / CAST(count({hit}) AS DOUBLE)"

    w = tables()
    out["kpi_stats"] = w.select(
        f"""SELECT (SELECT count(*) FROM runs) AS total_experiments,
        {avg('detection_accuracy', 'baseline')} AS baseline_detection_rate,
        {avg('detection_accuracy', 'proposed')} AS proposed_detection_rate,
        CAST(trunc({avg('false_negatives', 'baseline')}) AS BIGINT) AS baseline_false_negatives,
        CAST(trunc({avg('false_negatives', 'proposed')}) AS BIGINT) AS proposed_false_negatives,
        0.0::DOUBLE AS average_overhead_ms FROM results"""
    )
    out["experiment_list"] = w.select(
        """SELECT id, dataset_id, scenario_name AS scenario, ba AS baseline_accuracy, pa AS proposed_accuracy,
        started_at AS "timestamp" FROM sides ORDER BY id DESC"""
    )
    out["experiment_detail"] = w.select(
        """SELECT id, dataset_id, scenario_name AS scenario, 'compare' AS mode, 'completed' AS status,
        ba AS baseline_accuracy, bp AS baseline_precision, br AS baseline_recall, bfp AS baseline_false_positives,
        bfn AS baseline_false_negatives, pa AS proposed_accuracy, pp AS proposed_precision, pr AS proposed_recall,
        pfp AS proposed_false_positives, pfn AS proposed_false_negatives FROM sides WHERE id = 33"""
    )
    out["improvement"] = w.select(
        "SELECT id, scenario_name AS scenario, pa - ba AS accuracy_gain, bfn - pfn AS fn_reduction FROM sides"
    )
    values = ("precision", "recall", "false_positives", "false_negatives")
    w.add("named", "SELECT scenario_name AS scenario, results.* FROM results JOIN runs ON id = experiment_run_id")
    out["scenario_series"] = w.select(
        " UNION ALL ".join(
            [
                f"""SELECT scenario, '{v}' AS metric, {avg(f'"{v}"', 'proposed')} AS value FROM named GROUP BY scenario"""
                for v in values
            ]
            + [
                f"SELECT scenario, '{v}' AS metric, CAST(NULL AS DOUBLE) AS value FROM named GROUP BY scenario"
                for v in ("baseline_latency", "proposed_latency")
            ]
        )
    )

    def percent(value: str) -> str:
        return f"CAST(CAST(round(CAST({value} AS DECIMAL(20,10)) * 100, 1) AS DECIMAL(20,1)) AS VARCHAR) || '%'"

    out["report_export_rows"] = w.select(
        f"""SELECT id AS experiment_id, scenario_name AS scenario, {percent('ba')} AS baseline_accuracy,
        {percent('pa')} AS proposed_accuracy, {percent('pa - ba')} AS improvement FROM sides"""
    )
    w = tables(with_checks=True, with_results=False)
    out["stage_checks_for_run"] = w.select(
        """SELECT pipeline_type, stage_name AS stage, check_name AS "check", issue_type, passed,
        findings_count AS findings FROM checks WHERE experiment_run_id = 33"""
    )
    out["stage_pass_rate"] = w.select(
        """SELECT stage_name, pipeline_type, CAST(count_if(passed) AS DOUBLE) / count(*) AS pass_rate,
        CAST(sum(findings_count) AS BIGINT) AS findings FROM checks GROUP BY stage_name, pipeline_type"""
    )
    w = tables(with_checks=True)
    for key, keep in (("table_counts", "TRUE"), ("delete_cascade", "id NOT IN (SELECT id FROM runs WHERE scenario_name = 'mixed')")):
        named = [("experiment_runs", "runs", "id"), ("pipeline_results", "results", "experiment_run_id"),
                 ("stage_checks", "checks", "experiment_run_id")]
        out[key] = w.select(
            " UNION ALL ".join(
                f"""SELECT '{n}' AS "table", count(*) AS rows FROM (SELECT {c} AS id FROM {t}) WHERE {keep}"""
                for n, t, c in named
            )
        )
    out["table_counts"] += " UNION ALL SELECT 'datasets', count(DISTINCT o_orderpriority) FROM orders"


def all_oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in (_sources, _formats, _faults, _row_checks, _integrity, _reconcile, _flows, _evaluation, _analytics):
        part(out)
    out["deleted_by_log"] = out["delete_cascade"]
    return out
