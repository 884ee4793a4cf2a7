import io
import json
import zipfile
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lamina.operators.quality import QualityGateError
from lamina.sources import commit, control, edi, files, hl7, rest
from lamina.sources.store import TableStore

MSG = "FHS|x\r\njunk before\r\nMSH|^~\\&|APP|FAC|A|B|20240101||ORU|M1|P|2.5\nPID|1||P9^^^X\nPV1|1|I|D1^2|||||DOC^A|||||||||||E5\nORC|RE\nOBR|1|O1||C|S|20240101|202401020304|||||||||||||||20240105\nOBX|1|NM|C1^n^L||5.5|mg^x||HH|||F|||20240103\nOBX|2|ST|C2||a\\F\\b\\T\\c|||N|||F\nOBR|2|O2||C|R\nOBX|1|NM|C3||x\nMSH|^~\\&|APP|F2|A|B|20240102||ORU|M2\nPID|1||P8\nBTS|1\n"


def files_df(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, content string")


def test_hl7(spark):
    r = {(x.message_control_id, x.placer_order_id, x.set_id): x for x in hl7.typed_results(hl7.parse_results(files_df(spark, MSG), keep=("file",))).collect()}
    a, b, c, d = r["M1", "O1", "1"], r["M1", "O1", "2"], r["M1", "O2", "1"], r["M2", None, None]
    assert (a.patient_id, a.encounter_id, a.department_id, a.ordering_doctor_id, a.priority, a.loinc_code, float(a.result_value_numeric), a.is_critical) == ("P9", "E5", "D1^2", "DOC^A", "STAT", "C1", 5.5, True) and a.result_unit == "mg^x"
    assert a.result_ts == datetime(2024, 1, 3) and b.result_ts == datetime(2024, 1, 5) and a.collect_ts == datetime(2024, 1, 2, 3, 4)
    assert b.result_value_text == "a|b&c" and b.result_value_numeric is None and c.priority == "Routine" and c.result_value_numeric is None
    assert d.parse_error == hl7.NO_RESULT and d.sending_facility == "F2"


def test_hl7_empty_and_gate(spark):
    p = hl7.parse_results(files_df(spark, "", None, "no message here"))
    assert p.count() == 3 and p.filter("message_control_id is not null").count() == 0
    with pytest.raises(QualityGateError):
        hl7.check_results(p.limit(0))
    with pytest.raises(QualityGateError):
        hl7.check_results(hl7.parse_results(files_df(spark, MSG)))
    assert hl7.check_results(hl7.parse_results(files_df(spark, MSG)), 60)["errors"] == 1


ISA = "ISA*00*          *00*          *ZZ*SENDER         *ZZ*RECEIVER       *240101*1200*^*00501*000000009*0*P*:~"
CLAIMS = ISA + "\nGS*HC~\nST*837*0001~BHT*0019*00*1*20240101~NM1*41*2*S*****46*SUB~NM1*40*2*R*****46*REC~NM1*85*2*H*****XX*N1~SBR*P*18*******CI~NM1*IL*1*A*B****MI*M1~NM1*PR*2*P*****PI*Y1~CLM*C1*100***11:B:1~DTP*472*D8*20240102~HI*ABK:C349*ABF:I10~LX*1~SV1*HC:S1*60*UN*1~LX*2~SV1*HC:S2*40*UN*2~LX*2~SV1*HC:S2*40*UN*2~NM1*85*2*H*****XX*N2~SBR*S*18*******P9~NM1*IL*1*A*B****MI*M2~CLM*C2*50***21:B:1~SE*1*1~"


def test_claims_keep_their_own_context(spark):
    r = edi.parse_claims(files_df(spark, CLAIMS)).collect()
    got = sorted((x.claim_number, x.billing_provider_npi, x.subscriber_member_id, x.payer_id, x.place_of_service, x.primary_diagnosis_code, x.line_number, x.service_code, x.line_amount, x.parse_error) for x in r if x.claim_number == "C1")
    assert got == [("C1", "N1", "M1", "Y1", "11", "C349", "1", "S1", "60", None), ("C1", "N1", "M1", "Y1", "11", "C349", "2", "S2", "40", None)]
    (c2,) = (x for x in r if x.claim_number == "C2")
    assert (c2.billing_provider_npi, c2.subscriber_member_id, c2.payer_id, c2.place_of_service, c2.primary_diagnosis_code, c2.parse_error, c2.interchange_control_number) == ("N2", "M2", "P9", "21", None, edi.NO_LINES, "000000009")


def test_claims_without_payer_lines_or_envelope_names(spark):
    body = "BHT*0019*00*1*20240101~NM1*85*2*H*****XX*N1~SBR*P*18*******CI~NM1*IL*1*A*B****MI*M1~NM1*PR*2*P*****PI*Y1~CLM*C1*10***11~LX*1~SV1*HC:S*10*UN*1~"
    body += "SBR*P*18*******CI~NM1*IL*1*A*B****MI*M2~CLM*C2*20***11~LX*1~SV1*HC:S*20*UN*1~"  # names no payer: its own payer field
    body += "SBR*P*18~NM1*IL*1*A*B****MI*M3~CLM*C3*30***11~"  # nothing of its own, and no lines
    lines = "~".join(f"LX*{i}~SV1*HC:S{i}*1.00*UN*1" for i in range(1, 13))
    body += f"SBR*P*18~NM1*IL*1*A*B****MI*M4~NM1*PR*2*P*****PI*Y4~CLM*C4*99***11~{lines}~SE*1*1~"
    r = edi.parse_claims(files_df(spark, ISA + "GS*HC~ST*837*0001~" + body))
    head = {x.claim_number: (x.payer_id, x.subscriber_member_id, x.submitter_id, x.receiver_id) for x in r.collect()}
    assert head == {"C1": ("Y1", "M1", "SENDER", "RECEIVER"), "C2": ("CI", "M2", "SENDER", "RECEIVER"), "C3": ("Y1", "M3", "SENDER", "RECEIVER"), "C4": ("Y4", "M4", "SENDER", "RECEIVER")}
    assert [x.line_number for x in r.filter("claim_number = 'C4'").orderBy("line_no").collect()] == [str(i) for i in range(1, 13)]
    j = {x.claim_number: x for x in edi.claims_with_payment(r, edi.parse_remittances(files_df(spark, REMIT))).collect()}
    assert (j["C3"].payer_id, j["C3"].patient_source_id, float(j["C3"].billed_amount), j["C3"].line_count, float(j["C3"].denied_amount), j["C3"].is_denied, j["C3"].is_approved) == ("Y1", "M3", 30.0, 0, 30.0, True, False)
    assert (float(j["C1"].denied_amount), j["C1"].is_approved, j["C1"].days_to_payment, float(j["C1"].approved_amount)) == (16.5, True, 33, -6.5)
    assert (j["C4"].line_count, float(j["C4"].line_total), j["C4"].is_adjudicated, j["C4"].is_approved) == (12, 12.0, False, False)
    assert rows(edi.reconcile_remittances(edi.parse_remittances(files_df(spark, REMIT)), r)) == [(2, 0, 0.0, False)]
    assert rows(edi.reconcile_remittances(edi.parse_remittances(files_df(spark, REMIT)), r.filter("claim_number <> 'C3'"))) == [(2, 1, 50.0, True)]


def test_other_delimiters_and_short_files(spark):
    odd = CLAIMS.replace("\n", "").replace("*", "|").replace("~", "!")
    assert edi.parse_claims(files_df(spark, odd, "ISA*short", "", None)).count() == 3
    crlf = CLAIMS.replace("\n", "").replace("~", "\n")
    assert edi.parse_claims(files_df(spark, crlf)).count() == 3


REMIT = ISA + "GS*HP~ST*835*1~BPR*I*90*C*ACH*CCP*01*9*DA*1*9**01*9*DA*1*20240203~TRN*1*CHK*9~N1*PR*PAYER~N1*PE*PROV~CLP*C1*1*100*80*7*MC~CAS*CO*45*12.50**97*1~CAS*PR*2*3~CLP*C3*4*50*0*0*MC~SE*1*1~"


def test_remittances_and_reconciliation(spark):
    p = edi.parse_remittances(files_df(spark, REMIT))
    r = {x.claim_number: x for x in p.collect()}
    assert [(a.group, a.reason, float(a.amount)) for a in r["C1"].adjustments] == [("CO", "45", 12.5), ("CO", "97", 1.0), ("PR", "2", 3.0)]
    assert (r["C1"].payment_method, r["C1"].payment_date, r["C1"].payer_name, r["C1"].paid_amount, r["C3"].adjustments, r["C3"].adjustment_group) == ("ACH", "20240203", "PAYER", "80", [], None)
    claims = edi.parse_claims(files_df(spark, CLAIMS))
    assert rows(edi.unmatched_remittances(p, claims)) == [("C3",)]
    j = {x.claim_number: x for x in edi.claims_with_payment(claims.union(claims), p.union(p)).collect()}
    assert (float(j["C1"].line_total), float(j["C1"].paid_amount), float(j["C1"].adjustment_amount), j["C1"].line_count, j["C2"].paid_amount) == (100.0, 80.0, 16.5, 2, None)
    assert edi.check_claims(claims, 1) == 3
    with pytest.raises(QualityGateError):
        edi.check_claims(claims.limit(0), 1)


def test_pages_cover_every_row_once_with_ties():
    data = [{"id": f"{i:03}", "u": f"2024-01-{1 + i // 7:02}", "h": "A" if i % 2 else "B"} for i in range(50)]
    fetch = lambda p: rest.page_of(data, key="id", watermark="u", limit=p["limit"], cursor=p.get("cursor"), updated_since=p.get("updated_since"))
    assert [r["id"] for r in rest.all_pages(fetch, 7)] == [r["id"] for r in data]
    assert {r["u"] for r in rest.all_pages(fetch, 3, "2024-01-06")} == {"2024-01-07", "2024-01-08"}
    assert rest.page_of(data, key="id", watermark="u", limit=0)["pagination"]["limit"] == 1 and rest.page_of(data, key="id", watermark="u", limit=9999)["pagination"]["limit"] == 2000
    assert rest.page_of(data, key="id", watermark="u", filters={"h": "A"})["pagination"]["total_matching"] == 25
    with pytest.raises(ValueError):
        rest.page_of(data, key="id", watermark="u", cursor="junk")


def test_retries_back_off_and_give_up():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return "ok"

    assert rest.with_retries(flaky, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        rest.with_retries(lambda: (_ for _ in ()).throw(OSError("x")), attempts=2, sleep=waits.append)


def test_rest_source_over_http(spark):
    import http.server
    import threading
    import urllib.parse

    data = {e: [{"id": f"{e}{i}", "u": f"2024-01-{i + 1:02}"} for i in range(5)] for e in ("bed", "ward")}

    class H(http.server.BaseHTTPRequestHandler):
        def _send(self, o):
            b = json.dumps(o).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(b)))
            self.end_headers()
            self.wfile.write(b)

        def do_POST(self):
            self._send({"access_token": "t"})

        def do_GET(self):
            u = urllib.parse.urlparse(self.path)
            q = {k: v[0] for k, v in urllib.parse.parse_qs(u.query).items()}
            assert self.headers["Authorization"] == "Bearer t"
            self._send(rest.page_of(data[u.path.strip("/")], key="id", watermark="u", limit=int(q["limit"]), cursor=q.get("cursor")))

        def log_message(self, *a):
            pass

    srv = http.server.ThreadingHTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=srv.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{srv.server_port}"
    df = rest.pull(spark, "id string, u string", base_url=base, token_url=f"{base}/token", client_id="c", client_secret="s", entities="bed, ward", limit="2")
    assert rows(df, "entity", "id") == sorted((e, f"{e}{i}") for e in data for i in range(5))
    srv.shutdown()


def sheet(rows_):
    x = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows_, 1))
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{x}</sheetData></worksheet>')
    return b.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(sheet([["Title"], [], ["x"], ["doctor_id", None, "fte"], ["D1", "q", "0.5"], [None, None, None], ["D2"]]))
    assert rows(files.spreadsheet(spark, str(tmp_path / "a.xlsx"), ["doctor_id", "col_1", "fte"])) == [("D1", "q", "0.5"), ("D2", None, None)]
    (tmp_path / "t.csv").write_text("a,b\n007,x\n8,\n")
    assert files.text_table(spark, str(tmp_path / "t.csv")).orderBy("a").collect()[0].a == "007"
    (tmp_path / "p.json").write_text(json.dumps({"data": [{"id": "1"}, {"id": "2"}], "meta": {}}))
    assert rows(files.json_envelope(spark, str(tmp_path / "p.json"), "struct<id:string>")) == [("1",), ("2",)]
    assert files.unprefix(spark.createDataFrame([(1, 2)], "`data.x` int, other int")).columns == ["x"]
    (tmp_path / "m.hl7").write_text("MSH|1")
    assert files.whole_files(spark, str(tmp_path / "*.hl7")).first().content == "MSH|1"
    assert files.whole_files(spark, str(tmp_path / "*.none")).count() == 0
    assert files.dates(spark, "2024-02-28", "2024-03-01").count() == 3 and files.numbers(spark, 0, 1439).count() == 1440
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), (None,)], "w string")
    assert rows(files.changed_between(df, "w", "2024-01-01", "2024-01-02")) == [("2024-01-02",)] and files.changed_between(df, "w", "a", "b", "full").count() == 3


def test_store(spark, tmp_path):
    s = TableStore(spark, str(tmp_path / "lake"))
    assert not s.exists("t") and s.names() == []
    day = lambda d, n: spark.createDataFrame([(i, d) for i in range(n)], "x int, _load_date string")
    s.reload_partitions("t", day("2024-01-01", 3), "_load_date")
    s.reload_partitions("t", day("2024-01-02", 2), "_load_date")
    s.reload_partitions("t", day("2024-01-02", 4), "_load_date")
    assert s.read("t").groupBy().count().first()[0] == 7
    s.overwrite("u", spark.createDataFrame([(1, "a")], "k int, v string"))
    s.append("u", spark.createDataFrame([(2, "b", 9)], "k int, v string, extra int"))
    assert set(s.read("u").columns) == {"k", "v", "extra"}
    s.overwrite("u", s.read("u").select("k", "v"))
    s.upsert("u", spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), ["k"])
    s.compact("u", 1)
    assert rows(s.read("u").select("k", "v")) == [(1, "a"), (2, "z"), (3, "c")] and s.names() == ["t", "u"]
    s.drop("t")
    assert s.names() == ["u"]


def test_commit_reconciles(spark, tmp_path):
    s = TableStore(spark, str(tmp_path / "lake"))
    e = commit.Entity("API", "bed", "raw_bed", "full", "array")
    df = spark.createDataFrame([([("1", "x"), ("2", "y")],)], "data array<struct<id:string,v:string>>")
    for batch in ("b1", "b2"):
        m = commit.commit(s, df, e, batch_id=batch, now="2024-01-01 00:00:00", load_date="2024-01-01")
        assert m["rows_written"] == 2
    t = s.read("raw_bed")
    assert t.count() == 2 and set(commit.AUDIT) <= set(t.columns) and {r._batch_id for r in t.collect()} == {"b2"}


def test_control_lifecycle(spark):
    log = control.batch_start(control.empty_log(spark), batch_id="b1", now="2024-01-01 00:00:00", source_system="S", entity_name="e", watermark_to="2024-01-05")
    log = control.batch_start(log, batch_id="b2", now="2024-01-01 00:00:00", source_system="S", entity_name="f", watermark_to="2024-01-06")
    log = control.batch_end(log, batch_id="b1", status="STAGED", now="2024-01-01 00:01:00", rows_read=5, rows_written=5)
    log = control.batch_end(log, batch_id="b2", status="FAILED", now="2024-01-01 00:02:00", error="x")
    log = control.batch_end(log, batch_id="b2", status="SUCCESS", now="2024-01-01 00:03:00")  # not allowed from FAILED
    assert rows(log, "batch_id", "status", "duration_seconds") == [("b1", "STAGED", 60), ("b2", "FAILED", 120)]
    w0 = spark.createDataFrame([("S", "f", "2024-01-01", "b0", None)], "source_system string, entity_name string, watermark_value string, last_batch_id string, updated_ts timestamp")
    log2, w = control.commit_staged(log, w0, now="2024-01-02 00:00:00")
    assert rows(w, "entity_name", "watermark_value", "last_batch_id") == [("e", "2024-01-05", "b1"), ("f", "2024-01-01", "b0")]
    assert rows(log2, "batch_id", "status") == [("b1", "SUCCESS"), ("b2", "FAILED")]
    assert control.latest_watermark(w, "e") == "2024-01-05" and control.latest_watermark(w, "zz") == control.DEFAULT_WATERMARK
    assert rows(control.reset_watermark(w, "S", "e"), "entity_name") == [("f",)] and control.reset_watermark(w, "S").count() == 0
    reg = spark.createDataFrame([("S", "e", "db", True, 60), ("S", "f", "db", True, 60), ("S", "g", "api", True, 60), ("S", "h", "db", False, 60)], "source_system string, entity_name string, connection_type string, is_active boolean, sla_minutes int")
    assert rows(control.freshness(reg, log2, "2024-01-01 00:30:00"), "entity_name", "freshness") == [("e", "OK"), ("f", "FAILED"), ("g", "NEVER_RUN")]
    assert rows(control.freshness(reg, log2, "2024-01-01 09:00:00").filter("entity_name = 'e'"), "freshness") == [("STALE",)]
    assert rows(control.entities_to_ingest(reg, w, "db"), "entity_name", "watermark_value") == [("e", "2024-01-05"), ("f", "2024-01-01")]
    err = spark.createDataFrame([], "batch_id string, error_message string")
    assert rows(control.log_error(err, batch_id="b2", error_message="boom")) == [("b2", "boom")]
    assert control.run_history(log2, 1).count() == 1


def test_arrivals_stream(spark, tmp_path):
    from lamina.streaming.arrivals import commit_arrivals, distinct_within, message_files, windowed_counts

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.hl7").write_text(MSG.replace("M1", f"A{i}").replace("M2", f"B{i}"))
    s = TableStore(spark, str(tmp_path / "lake"))
    q = commit_arrivals(message_files(spark, str(tmp_path / "in"), "*.hl7", 2), lambda df: hl7.parse_results(df, keep=("file",)), s, commit.Entity("LAB", "result", "raw_result"), checkpoint=str(tmp_path / "ck"), load_date="2024-01-01", now="2024-01-01 00:00:00")
    q.awaitTermination()
    assert s.read("raw_result").count() == 12
    ev = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0)), (1, datetime(2024, 1, 1, 0, 1)), (2, datetime(2024, 1, 1, 0, 12))], "id int, ts timestamp")
    ev.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("id int, ts timestamp").parquet(str(tmp_path / "ev"))
    for name, df, mode in (("dw", distinct_within(stream, ["id"], "ts", "10 minutes"), "append"), ("wc", windowed_counts(stream, "ts", ["id"], size="10 minutes", delay="1 minute"), "update")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.table("dw").collect()) == [1, 2]
    assert sorted((r.id, r.events) for r in spark.table("wc").collect()) == [(1, 2), (2, 1)]
