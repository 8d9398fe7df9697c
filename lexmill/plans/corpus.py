"""Contract corpora derived from the star-schema tables.

The SQL is written once and rendered for Spark and for an ANSI engine, so the
two sides of a check read the same clauses. No step groups by document: a
clause is one line item, a paper is one order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, spread

ISO = {"spark": "date_format({c}, 'yyyy-MM-dd')", "ansi": "strftime({c}, '%Y-%m-%d')"}


def iso(column: str, dialect: str) -> str:
    return ISO[dialect].format(c=column)


def clauses_sql(dialect: str, lineitem: str = "lineitem", orders: str = "orders",
                embeddings: str = "embeddings", doc: str = "l_orderkey") -> str:
    """doc_id, clause_id, section_no, section_name, text_content, page_num, part_no, vec_id.

    clause_id numbers equal (order, line) rows; that window holds one line of one
    order, never a whole document.
    """
    day = iso("l_shipdate", dialect)
    return f"""
SELECT {doc} AS doc_id,
       (l_orderkey * 8 + l_linenumber) * 1000 + rn AS clause_id,
       CAST(l_linenumber AS BIGINT) AS section_no,
       CASE WHEN l_linenumber % 2 = 1 THEN concat('Section ', l_linenumber, '. ', title)
            ELSE concat(l_linenumber, '. ', title) END AS section_name,
       text_content,
       CAST(floor((l_linenumber - 1) / 3) AS BIGINT) + 1 AS page_num,
       kind, l_orderkey AS order_key, l_partkey AS part_no, l_suppkey AS supp_no
FROM (
  SELECT *,
    CASE kind WHEN 0 THEN 'Payment' WHEN 1 THEN 'Termination' WHEN 2 THEN 'Limitation of Liability'
              WHEN 3 THEN 'Confidentiality' WHEN 4 THEN 'Governing Law' WHEN 5 THEN 'Indemnity'
              WHEN 6 THEN 'Notices' ELSE 'Schedule' END AS title,
    CASE kind
      WHEN 0 THEN concat('Customer shall pay USD ', price, ' within ', qty, ' days of the invoice. A late fee of ',
                         disc, '% applies and interest accrues after the due date.')
      WHEN 1 THEN concat('Supplier ', modal, ' terminate this agreement with a notice period of ', qty,
                         ' days, effective date ', day, '. A cure period of ', ref, ' weeks is granted on written notice.')
      WHEN 2 THEN concat('Limitation of liability: the liability of Vendor under Section ', ref,
                         ' is capped at USD ', price, '. In no event shall a party be liable for consequential damages.')
      WHEN 3 THEN concat('Recipient shall not disclose confidential information for ', ref, ' years after ', day,
                         ', unless required by law.')
      WHEN 4 THEN concat('This agreement is governed by the laws of the State of ', state,
                         '. The courts of ', state, ' have exclusive jurisdiction.')
      WHEN 5 THEN concat('Vendor shall indemnify and hold harmless the Client from losses and claims, as set out in Section ',
                         ref, '. Unlimited indemnification applies and Vendor may waive any penalty of ', disc, '%.')
      WHEN 6 THEN concat('Client must notify Supplier by registered mail within ', ref, ' weeks, see Section ', ref,
                         ' and Clause ', 8 - ref, '. Notices should be in writing.')
      ELSE concat('Sum Insured (in Rs.): ', price, '.') END AS text_content
  FROM (
    SELECT *, {day} AS day,
      CAST(floor(l_extendedprice) AS BIGINT) AS price, CAST(floor(l_quantity) AS BIGINT) AS qty,
      CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS disc, 1 + l_partkey % 7 AS ref,
      (l_orderkey + l_linenumber + l_partkey) % 8 AS kind,
      CASE l_partkey % 3 WHEN 0 THEN 'may' WHEN 1 THEN 'shall' ELSE 'shall not' END AS modal,
      CASE l_suppkey % 5 WHEN 0 THEN 'Texas' WHEN 1 THEN 'New York' WHEN 2 THEN 'Delaware'
                         WHEN 3 THEN 'Ohio' ELSE 'Nevada' END AS state,
      row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                         ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                                  l_returnflag, l_linestatus, l_shipdate) AS rn
    FROM {lineitem}) l0 ) l1"""


PAPER_TYPES = 6


def papers_sql(dialect: str, orders: str = "orders") -> str:
    """One document per order: doc_id, user_id, paper_kind, uploaded, full_text and file facts."""
    day = iso("o_orderdate", dialect)
    return f"""
SELECT doc_id, user_id, paper_kind, uploaded, has_qr, has_signature, pages_scanned, qr_failed, ext, price,
       replace(CASE paper_kind
        WHEN 0 THEN concat('Insurance Policy~Issued by: Harbour General Insurance Company Limited~',
              'Policy Number: HG-', doc_id, '-', tail, '~Policyholder: Alan Poe~',
              'Policy Period: ', day, ' to 2031-01-15~Sum Assured: ', price, '~',
              'Base premium: ', base, '~GST: 18%~Total premium payable: ', total, '~Insured name: Alan Poe~',
              'Vehicle registration number: KA 05 MH ', 1000 + doc_id % 9000, '~Engine No: EN', 10000 + doc_id % 90000, '~',
              'Premium paid USD ', total, '. Transaction ID ', doc_id, '~IRDAI Reg No: 123-', tail, '~',
              'Previous Policy No: HG-1~Policy Number: HG-', doc_id, '-', tail2, '~Sum Assured: ', price2, '~Signed')
        WHEN 1 THEN concat('Loan Agreement~between Lender and Borrower dated ', day, '~Principal amount: ', price,
              '~The principal amount of ', price2, ' is due. Repayment in installment form. Interest rate 7%.~Signature')
        WHEN 2 THEN concat('Non-Disclosure Agreement~Disclosing party and receiving party~',
              'Confidential information means all data. Governed by law. Period of confidentiality applies.~Signed ', day)
        WHEN 3 THEN concat('Service Agreement~Service provider and client, scope of work, fees: ', price,
              '. Total fees: ', price2, '. Term of one year. Payment monthly. Signed ', day)
        WHEN 4 THEN concat('Sale deed registered by vendor, consideration amount ', price, ', dated ', day, ', signed')
        ELSE concat('Memo about delivery no ', doc_id, ' sent on ', day) END, '~', chr(10)) AS full_text
FROM (
  SELECT o_orderkey AS doc_id, o_custkey % 10 AS user_id, o_orderkey % {PAPER_TYPES} AS paper_kind,
         o_orderdate AS uploaded,
         CAST(floor(o_totalprice) AS BIGINT) AS price,
         CAST(floor(o_totalprice) AS BIGINT) + CASE o_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 90000 END AS price2,
         100 + o_custkey % 900 AS base,
         CASE o_custkey % 4 WHEN 0 THEN 500 ELSE CAST(floor((100 + o_custkey % 900) * 1.18) AS BIGINT) END AS total,
         o_custkey % 1000 AS tail, o_custkey % 1000 + CASE o_custkey % 5 WHEN 0 THEN 111 ELSE 0 END AS tail2,
         o_custkey % 2 = 0 AS has_qr, o_custkey % 3 = 0 AS has_signature, o_orderkey % 11 AS pages_scanned,
         o_custkey % 13 = 0 AS qr_failed,
         CASE o_custkey % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.txt' ELSE '.pdf' END AS ext, {day} AS day
  FROM {orders}) o0"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def clauses(spark: SparkSession, sf: str, doc: str = "l_orderkey", by_document: bool = False) -> DataFrame:
    """by_document: rows are dealt by document before anything is made of them, so windows inside a document move none again.

    The number of parts is given, since lines are short: merged by their size, their texts would not fit and sorts would spill.
    """
    lines = table(spark, sf, "lineitem")
    if by_document:
        lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), doc)
    return spark.sql(clauses_sql("spark", "{lineitem}", doc=doc), lineitem=lines)


KINDS = ["Payment", "Termination", "Liability", "Confidentiality", "Jurisdiction", "Indemnity", "Notices", "Structured Field"]


def kinds_sql() -> str:
    return "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS[:-1])) + f" ELSE '{KINDS[-1]}' END"


def kind_clauses(spark: SparkSession, sf: str, by_document: bool = False) -> DataFrame:
    """Clauses with the classification of their template."""
    return clauses(spark, sf, by_document=by_document).withColumn("classification", F.expr(kinds_sql()))


def papers(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(papers_sql("spark", "{orders}"), orders=spread(table(spark, sf, "orders")))


def ansi_clauses(doc: str = "l_orderkey") -> str:
    return f"({clauses_sql('ansi', doc=doc)})"


def ansi_papers() -> str:
    return f"({papers_sql('ansi')})"


def scratch(spark, name):
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
