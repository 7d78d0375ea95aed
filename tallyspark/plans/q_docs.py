"""Registered queries: document text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import documents as DOC
from ..operators import reconcile as RC
from ..session import stage_table, table
from . import fixtures as FX
from .q_core import s_null_tokens, s_parse_date
from .registry import query

TXT = ("inv_texts",)


def _s_regex(pat: str) -> str:
    return pat.replace("'", "''")


_FIELDS_SQL = "SELECT doc_id, " + ", ".join(
    (f"nullif(replace(regexp_extract(text, '{_s_regex(p)}', 1), ',', ''), '') AS \"{n}\"" if nc else
     f"nullif(regexp_extract(text, '{_s_regex(p)}', 1), '') AS \"{n}\"")
    for n, p, nc in K.DOC_FIELD_PATTERNS) + " FROM inv_texts"


@query("extract_document_fields", _FIELDS_SQL, TXT)
def extract_document_fields(spark, sf):
    return DOC.extract_document_fields(FX.invoice_texts(spark, sf), keep=["doc_id"])


def _norm(x: str) -> str:
    return f"replace(replace(replace(upper({x}), ' ', ''), '-', ''), '_', '')"


_KEYS = " UNION ALL ".join(
    f"SELECT {i} AS col_rank, CAST(\"InvID\" AS BIGINT) AS row_order, {_norm(s_null_tokens(chr(34) + c + chr(34)))} AS key "
    f"FROM ledger" for i, c in enumerate(K.MATCH_COLUMNS))
MATCH_SQL = f"""
WITH keys AS (SELECT *, CASE WHEN length(key) >= 4 THEN substr(key, 1, length(key) * 4 // 5) ELSE key END AS probe
              FROM ({_KEYS}) WHERE key IS NOT NULL AND length(key) > 0),
     docs AS (SELECT doc_id, {_norm("coalesce(text, '')")} AS t FROM inv_texts),
     win AS (SELECT d.doc_id, arg_min(k.col_rank, k.col_rank * 10000000000000 + k.row_order) AS c,
                    arg_min(k.row_order, k.col_rank * 10000000000000 + k.row_order) AS r,
                    arg_min(k.key, k.col_rank * 10000000000000 + k.row_order) AS key
             FROM docs d JOIN keys k ON contains(d.t, k.probe) GROUP BY d.doc_id),
     res AS (SELECT d.doc_id, CASE WHEN length(d.t) = 0 THEN '❌ No Data' WHEN w.key IS NULL THEN '❌ Not Matched'
                               WHEN contains(d.t, w.key) THEN '✅ VALID' ELSE '⚠️ PARTIAL' END AS "Validation_Result",
                    w.c AS matched_column_rank, w.r AS matched_row, w.key AS matched_key
             FROM docs d LEFT JOIN win w ON d.doc_id = w.doc_id)
"""


def _match_ledger(spark, sf, *more):
    """The ledger's columns that texts are matched to, derived once for the probes and for the rows that won."""
    return stage_table(FX.ledger(spark, sf).select(*K.MATCH_COLUMNS, *more), "ledger", "zstd")


@query("match_text_to_ledger", MATCH_SQL + """
SELECT res.*, l."PurchaseInvNo", l."PartyName",
       CASE WHEN contains("Validation_Result", 'VALID') THEN '✅' WHEN contains("Validation_Result", 'PARTIAL') THEN '⚠️'
            ELSE '' END AS "Correct",
       CASE WHEN contains("Validation_Result", 'Not Matched') OR contains("Validation_Result", 'Error') THEN '🚩'
            ELSE '' END AS "Flagged"
FROM res LEFT JOIN ledger l ON CAST(l."InvID" AS BIGINT) = res.matched_row""", ("inv_texts", "ledger"))
def match_text_to_ledger(spark, sf):
    led = _match_ledger(spark, sf, "PartyName")
    res = DOC.match_text_to_ledger(FX.invoice_texts(spark, sf), led)
    return DOC.attach_matched_rows(res, led, fields=["PurchaseInvNo", "PartyName"])


@query("match_rate", MATCH_SQL + """SELECT count(*) AS documents,
  count_if("Validation_Result" IN ('✅ VALID', '⚠️ PARTIAL')) AS matched,
  CAST(floor((count_if("Validation_Result" IN ('✅ VALID', '⚠️ PARTIAL')) * 20000 + count(*)) / (count(*) * 2)) / 100
       AS DECIMAL(9,2)) AS match_rate FROM res""", ("inv_texts", "ledger"))
def match_rate(spark, sf):
    return DOC.match_rate(DOC.match_text_to_ledger(FX.invoice_texts(spark, sf), _match_ledger(spark, sf)))


_WS = "' ' || chr(9) || chr(13) || chr(10)"
_T2T = f"""
WITH k AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r'),
              lambda ln: list_filter(list_transform(string_split_regex(trim(ln, {_WS}), '\\s{{2,}}|\\t|,|;'),
                                                    lambda p: trim(p, {_WS})), lambda p: p <> '')),
              lambda p: len(p) >= 2) AS kept FROM documents),
     h AS (SELECT doc_id, kept, CASE WHEN len(kept) = 0 THEN [] ELSE
             list_reduce(kept, lambda acc, x: CASE WHEN len(x) > len(acc) THEN x ELSE acc END) END AS hdr FROM k),
     n AS (SELECT doc_id, kept, list_transform(hdr, lambda x, i: CASE WHEN x = '' OR regexp_full_match(x, '[0-9]+')
             THEN 'col_' || CAST(i - 1 AS VARCHAR) ELSE x END) AS header FROM h),
     r AS (SELECT doc_id, header, list_filter(kept, lambda x: len(x) = len(header)) AS rows FROM n)
SELECT doc_id, row_no, n_cols, header, cells FROM (
  SELECT doc_id, generate_subscripts(rows, 1) - 1 AS row_no, len(header) AS n_cols,
         array_to_string(header, ' | ') AS header, array_to_string(unnest(rows), ' | ') AS cells FROM r WHERE len(rows) > 0)
"""


@query("text_to_table", _T2T)
def text_to_table(spark, sf):
    t = DOC.text_to_table(table(spark, sf, "documents"))
    return t.select("doc_id", "row_no", "n_cols", F.array_join("header", " | ").alias("header"),
                    F.array_join("cells", " | ").alias("cells"))


@query("scan_emails", f"""SELECT doc_id, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS email,
  regexp_full_match(unnest(m), '{K.EMAIL_RE[1:-1]}') AS valid
FROM (SELECT doc_id, regexp_extract_all(text, '{K.EMAIL_SCAN_RE}', 0) AS m FROM documents) WHERE len(m) > 0""")
def scan_emails(spark, sf):
    return DOC.scan_emails(table(spark, sf, "documents"))


@query("split_emails", f"""WITH r AS (SELECT c_custkey, trim(unnest(string_split_regex(
    concat('ap', c_custkey, '@mail.org; ', c_name, ' , bad', c_custkey, '@, ;x.', c_custkey, '@host', c_nationkey, '.co.in;'), '[;,]'))) AS email FROM customer)
SELECT c_custkey, email, regexp_full_match(email, '{K.EMAIL_RE[1:-1]}') AS valid FROM r WHERE email <> ''""")
def split_emails(spark, sf):
    """Recipients as they are typed: separators of both kinds, blanks, names and broken addresses, which are reported."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("ap"), key, F.lit("@mail.org; "), "c_name", F.lit(" , bad"), key, F.lit("@, ;x."), key, F.lit("@host"), F.col("c_nationkey").cast("string"),
                    F.lit(".co.in;"))
    return DOC.split_emails(table(spark, sf, "customer").withColumn("recipients", text), "recipients", ["c_custkey"])


@query("archive_completeness", """
WITH got AS (SELECT lang AS batch, count_if(lower(name) LIKE '%.pdf') AS pdf_members FROM
               (SELECT lang, CASE WHEN doc_id % 5 = 0 THEN 'doc_' || doc_id || '.txt' ELSE 'doc_' || doc_id || '.pdf' END
                AS name FROM documents) GROUP BY 1),
     exp AS (SELECT lang AS batch, count(*) AS expected FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT e.batch, e.expected, coalesce(g.pdf_members, 0) AS pdf_members,
       CAST(floor(CASE WHEN e.expected > 0 THEN coalesce(g.pdf_members, 0) / e.expected ELSE 0 END * 10000) / 10000
            AS DECIMAL(12,4)) AS ratio,
       CASE WHEN e.expected > 0 THEN coalesce(g.pdf_members, 0) / e.expected ELSE 0 END >= 0.95 AS complete
FROM exp e LEFT JOIN got g ON e.batch = g.batch""")
def archive_completeness(spark, sf):
    d = table(spark, sf, "documents")
    members = d.select(F.col("lang").alias("batch"), F.concat(
        F.lit("doc_"), F.col("doc_id").cast("string"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(".txt")).otherwise(F.lit(".pdf"))).alias("name"))
    expected = (table(spark, sf, "labels").join(d, "doc_id").groupBy(F.col("lang").alias("batch"))
                .agg(F.count(F.lit(1)).alias("expected")))
    return DOC.archive_completeness(members, expected, "batch", "name")


@query("file_gate", """SELECT doc_id, octet_length(encode(text)) AS size,
  octet_length(encode(text)) >= 1024 AND octet_length(encode(text)) <= 52428800 AS accepted,
  length(text) > 100000 AS over_char_cap FROM documents""")
def file_gate(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.octet_length("text").alias("size"),
                                            F.lit("document").alias("kind"))
    return DOC.file_gate(d, "size", "kind", "text").select("doc_id", "size", "accepted", "over_char_cap")


@query("match_file_to_invoice", """
WITH f AS (SELECT * FROM doc_names WHERE size >= 1024),
     num AS (SELECT DISTINCT invoice_number FROM invoices WHERE invoice_number <> ''),
     hits AS (SELECT f.doc_id, f.name, f.size, invoice_number AS matched_invoice FROM f JOIN num ON contains(f.name, invoice_number))
SELECT doc_id, name, size, matched_invoice, 'id_in_name' AS match_kind FROM hits
UNION ALL
SELECT doc_id, name, size, NULL, 'candidate' FROM f WHERE name NOT IN (SELECT name FROM hits)
  AND regexp_matches(lower(name), 'inv(oice)?[-_]?\\d+')
UNION ALL
SELECT doc_id, name, size, NULL, 'too_small' FROM doc_names WHERE size < 1024""", ("doc_names",))
def match_file_to_invoice(spark, sf):
    return RC.match_file_to_invoice(FX.doc_file_names(spark, sf), FX.invoices(spark, sf), "name", "invoice_number",
                                    size="size")


_MERGE_SQL = f"""
WITH f AS ({_FIELDS_SQL}),
     l AS (SELECT "Invoice_Number" AS invoice, doc_id AS file_order, unnest(map_keys(m)) AS field,
                  unnest(map_values(m)) AS value
           FROM (SELECT *, MAP {{{', '.join(f"'{n}': \"{n}\"" for n, _, _ in K.DOC_FIELD_PATTERNS)}}} AS m FROM f)
           WHERE "Invoice_Number" IS NOT NULL),
     kv AS (SELECT * FROM l WHERE value IS NOT NULL AND value <> ''),
     fs AS (SELECT invoice, field, min(file_order) AS first FROM kv GROUP BY 1, 2),
     np AS (SELECT invoice, first AS file_order, count(*) AS new FROM fs GROUP BY 1, 2),
     cum AS (SELECT *, sum(new) OVER (PARTITION BY invoice ORDER BY file_order ROWS UNBOUNDED PRECEDING) AS c FROM np),
     stp AS (SELECT invoice, min(file_order) AS stop FROM cum WHERE c >= 5 GROUP BY 1)
SELECT kv.invoice, field, arg_max(value, kv.file_order) AS value, any_value(stp.stop) AS stopped_at FROM kv
LEFT JOIN stp USING (invoice) WHERE stp.stop IS NULL OR kv.file_order <= stp.stop GROUP BY 1, 2"""


@query("merge_document_fields", _MERGE_SQL, TXT)
def merge_document_fields(spark, sf):
    f = DOC.extract_document_fields(FX.invoice_texts(spark, sf), keep=["doc_id"])
    names = [n for n, _, _ in K.DOC_FIELD_PATTERNS]
    long = f.where(F.col("Invoice_Number").isNotNull()).select(
        F.col("Invoice_Number").alias("invoice"), F.col("doc_id").alias("file_order"),
        F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names])))
        .alias("field", "value"))
    return RC.merge_document_fields(long, "invoice", "file_order")


@query("late_upload", f"""SELECT "InvID", CASE WHEN {s_parse_date('"PurchaseInvDate"')} IS NULL
  OR {s_parse_date('"Voucherdate"')} IS NULL THEN ''
  WHEN date_diff('day', {s_parse_date('"PurchaseInvDate"')}, {s_parse_date('"Voucherdate"')}) > 3 THEN 'Yes'
  ELSE 'No' END AS late_upload FROM ledger""", ("ledger",))
def late_upload(spark, sf):
    from ..functions import exprs as X
    led = FX.ledger(spark, sf)
    inv, entry = X.parse_date("PurchaseInvDate"), X.parse_date("Voucherdate")
    late = (F.when(inv.isNull() | entry.isNull(), F.lit("")).when(F.datediff(entry, inv) > 3, F.lit("Yes"))
             .otherwise(F.lit("No")))
    return led.select("InvID", late.alias("late_upload"))
