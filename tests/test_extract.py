import json

from pyspark.sql import functions as F

from devident.operators import extract
from devident.operators.baseline import scanner_cpes, session_cpes
from devident.operators.payload import payload_text

FULL = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE nmaprun>
<!-- by a scanner -->
<nmaprun args="nmap -sV" version="7.94" startstr="Mon"><prescript><script id="a" output=" pre a "/><script id="b" output="pre b"/></prescript>
<host><status state="down"/><address addr="9.9.9.9" addrtype="ipv4"/></host>
<host><status/><address addr="9.9.9.8" addrtype="ipv4"/></host>
<host><address addr="AA" addrtype="mac"/><ports><port portid="7"><state state="open"/><service><cpe>cpe:/a:only:mac</cpe></service></port></ports></host>
<host><status state="up"/><address addr="1.1.1.1" addrtype="ipv4"/><address addr="1.1.1.2" addrtype="ipv4"/><address addr="AA:BB" addrtype="mac" vendor="Acme"/>
<hostnames></hostnames><hostscript><script id="nbstat" output="NetBIOS name: BOX, x"><table key="k"><elem>1</elem></table></script><script id="nbstat" output="zz"/><script id="q" output="  "/><script output="no id"/></hostscript>
<os><osmatch name="Linux" accuracy="98"><osclass cpe="cpe:/o:l:k"><cpe>cpe:/o:l:k</cpe><cpe> cpe:/o:l:z </cpe></osclass></osmatch><osmatch name="Bare"/><osmatch accuracy="3"/></os>
<ports><port protocol="tcp" portid=" 80 "><state state="open"/><service name="http" product="P" version="1"><cpe> cpe:/a:p:q </cpe><cpe/></service><script id="s" output="one"/><script id="t" output="tee"/><script id="s" output="two&#xa;lines"/></port>
<port protocol="tcp" portid="81"><state state="closed"/></port><port portid="82"/><port portid="83"><state state="open"/></port></ports><ports><port portid="99"><state state="open"/></port></ports></host>
<host><status state="up"/><address addr="2.2.2.2" addrtype="ipv4"/><ports><port portid="1"><state state="open"/><service><cpe>cpe:/a:second:host</cpe></service></port></ports></host>
<postscript><script id="a" output="post a"/><script id="c" output="post c"/></postscript>
<runstats><finished timestr="Tue" exit="success"/></runstats></nmaprun>
<!-- end -->
"""
MINIMAL = '<nmaprun><host><address addr="1" addrtype="ipv4"/><hostnames><hostname name="n"/></hostnames></host><runstats><finished exit="error"/></runstats></nmaprun>'
BAD = ["<nmaprun", "", None, "<nmaprun></nmaprun><nmaprun></nmaprun>", "<nmaprun></nmaprun> text", "no xml", "<nmaprun><host></nmaprun>"]


def scans(rows):
    texts = [FULL, MINIMAL, "<nmaprun/>", *BAD]
    return rows("i int, xml string", list(enumerate(texts))).withColumns(
        {"device_code": F.lit("dev"), "scan_name": F.lit("sc")}
    )


def test_primary_host_and_meta(rows):
    hosts = {r.i: r for r in extract.primary_hosts(scans(rows)).collect()}
    assert set(hosts) == {0, 1}
    full, minimal = hosts[0], hosts[1]
    assert (full.command, full.tool_version, full.start_time, full.end_time, full.exit_code) == ("nmap -sV", "7.94", "Mon", "Tue", 1)
    assert (full.ip, full.mac, full.vendor, full.hostname) == ("1.1.1.2", "AA:BB", "Acme", "BOX,")
    assert full.os_guesses == ["Linux (98%)", "Bare"]
    assert full.os_cpes == ["cpe:/o:l:k", "cpe:/o:l:z"]
    assert [s.port for s in full.services] == [80, 83]
    assert full.services[0].cpes == [" cpe:/a:p:q "]
    assert [(s.id, s.output) for s in full.services[0].scripts] == [("s", "two\nlines"), ("t", "tee")]
    assert [(s.id, s.output) for s in full.host_scripts] == [("nbstat", "zz")]
    assert (minimal.exit_code, minimal.end_time, minimal.hostname, minimal.services) == (0, None, "n", [])


def test_rejected_documents(rows):
    reasons = {r.i: r.reason for r in extract.rejected_documents(scans(rows)).collect()}
    assert reasons == {2: "no live host", **{3 + k: "malformed document" for k in range(len(BAD))}}


def test_one_row_per_port_and_script(rows):
    hosts = extract.primary_hosts(scans(rows))
    assert [(r.service_pos, r.port) for r in extract.open_services(hosts).orderBy("service_pos").collect()] == [(0, 80), (1, 83)]
    found = sorted((r.scope, r.port or 0, r.id) for r in extract.host_scripts(hosts).collect())
    assert found == [("host", 0, "nbstat"), ("port", 80, "s"), ("port", 80, "t"), ("post", 0, "a"), ("post", 0, "c"), ("pre", 0, "a"), ("pre", 0, "b")]


def test_host_json(rows):
    text = extract.primary_hosts(scans(rows)).filter("i = 1").select(extract.host_json()).first()[0]
    assert json.loads(text) == {
        "ip": "1", "mac": None, "vendor": None, "hostname": "n", "os_guesses": [], "os_cpes": [], "services": [],
        "host_scripts": {}, "pre_scripts": {}, "post_scripts": {},
    }


def test_payload(rows):
    texts = {r.i: r.t for r in extract.primary_hosts(scans(rows)).select("i", payload_text().alias("t")).collect()}
    assert texts[0] == "\n".join(
        [
            "Device: dev", "Scan:   sc", "IP:     1.1.1.2", "Hostname: BOX,", "Vendor (nmap): Acme", "",
            "OS Guesses:", "  Linux (98%)", "  Bare", "",
            "Open Ports:", "  80/tcp       http       P 1", "    nmap CPE:  cpe:/a:p:q ", "    [s] two\nlines", "    [t] tee",
            "  83/None                 ", "",
            "Host Scripts:", "  [nbstat]", "  zz", "",
            "Discovery Scripts:", "  [a]", "  post a", "  [b]", "  pre b", "  [c]", "  post c", "",
            "nmap CPE Guesses (all services):", "   cpe:/a:p:q ",
        ]
    )
    assert texts[1].endswith("Open Ports:\n  (none)\n\nnmap CPE Guesses (all services):\n  (none)")
    assert "OS Guesses:\n  (none detected)\n" in texts[1]


def test_long_scripts_are_cut(rows):
    xml = (
        '<nmaprun><host><address addr="1" addrtype="ipv4"/><hostscript><script id="h" output="%s"/></hostscript>'
        '<ports><port protocol="tcp" portid="1"><state state="open"/><script id="p" output="%s"/></port></ports></host></nmaprun>'
    ) % ("h" * 700, "p" * 700)
    frame = rows("xml string, device_code string, scan_name string", [(xml, "d", "s")])
    text = extract.primary_hosts(frame).select(payload_text()).first()[0]
    assert (text.count("h" * 500), text.count("h" * 501)) == (1, 0)
    assert (text.count("p" * 200), text.count("p" * 201)) == (1, 0)


def test_scanner_cpes(rows):
    found = {r.i: r.cpes for r in scanner_cpes(scans(rows)).collect()}
    assert [c.replace(":*", "") for c in found[0]] == [
        "cpe:2.3:a:only:mac", "cpe:2.3:a:p:q", "cpe:2.3:o:l:k", "cpe:2.3:o:l:z", "cpe:2.3:a:second:host",
    ]
    assert all(found[i] == [] for i in found if i)


def test_sessions_merge_in_first_seen_order(rows):
    def doc(*cpes):
        return '<nmaprun><host><ports><port portid="1"><state state="open"/><service>%s</service></port></ports></host></nmaprun>' % "".join(
            f"<cpe>cpe:/a:{c}:p</cpe>" for c in cpes
        )

    runs = rows(
        "id long, scan_session_id long, stdout_text string, tool_version string",
        [(5, 1, doc("b", "c"), "5"), (3, 1, doc("a", "b"), None), (2, 1, "", "2"), (1, 2, None, "1"), (9, 3, "<broken", "9")],
    )
    merged = {r.scan_session_id: r for r in session_cpes(runs).collect()}
    assert [c.split(":")[3] for c in merged[1].cpes] == ["a", "b", "c"]
    assert merged[1].tool_version == "5"
    assert (merged[2].cpes, merged[2].tool_version) == ([], None)
    assert (merged[3].cpes, merged[3].tool_version) == ([], "9")


def test_documents_are_parsed_once(rows):
    for frame in (
        extract.primary_hosts(scans(rows)), extract.open_services(extract.primary_hosts(scans(rows))),
        extract.rejected_documents(scans(rows)), scanner_cpes(scans(rows)),
    ):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1


def test_long_endings(rows):
    end = "</nmaprun>" + "\n" * 200_000 + "<!-- " + "x" * 200_000 + " -->" + " " * 200_000
    frame = rows("i int, xml string", [(1, MINIMAL.replace("</nmaprun>", end)), (2, MINIMAL.replace("</nmaprun>", end + "x"))])
    assert [r.i for r in extract.primary_hosts(frame).collect()] == [1]


def test_only_what_details_need_is_read(rows):
    """Fewer details: the same rows and values, malformed documents included, from a smaller schema."""
    odd = [
        "<nmaprun><host><status/></host><os></nmaprun>", "<nmaprun>text<host>t<address addr='2' addrtype='ipv4'/><os>x</os></host></nmaprun>",
        "<nmaprun><host><os><osmatch><osclass><cpe>a<b/></cpe></osclass></osmatch></os><address addr='3' addrtype='ipv4'/></host></nmaprun>",
        "<nmaprun><host><address addr='4' addrtype='ipv4'/><ports><port portid='1'><state state='open'/><script id='a' output=' '/></port></ports></host>",
        "<nmaprun><host><address addr='5' addrtype='ipv4'/><ports><port a='1' a='2'/></ports></host></nmaprun>",
    ]
    texts = scans(rows).select("i", "xml").unionByName(rows("i int, xml string", [(100 + n, t) for n, t in enumerate(odd)]))
    whole = extract.primary_hosts(texts)
    for details in (["os"], ["hostname"], ["meta"], ["services"], ["scripts"], ["os", "services"], []):
        part = extract.primary_hosts(texts, details=details)
        assert set(part.columns) < set(whole.columns)
        assert sorted(part.collect(), key=str) == sorted(whole.select(*part.columns).collect(), key=str), details
    part = extract.host_scripts(extract.primary_hosts(texts, details=["port_scripts", "scripts"])).select("i", "scope", "port", "id", "output")
    assert sorted(part.collect(), key=str) == sorted(extract.host_scripts(whole).select(*part.columns).collect(), key=str)


def test_queries_read_what_they_return(spark, monkeypatch):
    """The queries that return a part of a document don't have the rest of it built."""
    from devident.plans import binding, catalog

    documents = spark.createDataFrame([(1, FULL)], "seq long, xml string")
    monkeypatch.setattr(binding, "scan_documents", lambda *_: documents)
    for name, absent in (("os_identity", "ports"), ("open_services", "osmatch"), ("scripts", "osmatch"), ("scripts", "_product"), ("bad_documents", "ports")):
        found = catalog.QUERIES[name](spark, "")
        assert absent not in found._jdf.queryExecution().optimizedPlan().toString(), (name, absent)
        found.collect()
