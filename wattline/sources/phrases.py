"""Texts with what must be read from them, as rows of VALUES: they are joined with orders, so that every query's work grows with the data.

{Y} is a year of the order, {Z} the next one, {V} its value, {N} a name.
"""

from __future__ import annotations

#: text, period, metric, value type, scope ('' for none), whole year
CLUES = [
    ("Plant A actual annual generation was 5 GWh", "calendar_year", "gross_generation", "actual", "plant", True),
    ("rolling 12 months generation of the station", "rolling_12_months", "gross_generation", "", "plant", False),
    ("trailing 12 month net generation", "rolling_12_months", "net_generation", "", "", False),
    ("滚动12个月发电量", "rolling_12_months", "unknown", "", "", False),
    ("YTD net electricity generation 12 GWh", "ytd", "net_generation", "", "", False),
    ("截至9月底累计发电 100 GWh", "ytd", "unknown", "", "", False),
    ("Q3 energy sent out is on target", "quarter", "energy_sent_out", "forecast", "", False),
    ("第二季度售电量已完成", "quarter", "electricity_sales", "actual", "", False),
    ("FY 2021 power sales", "fiscal_year", "electricity_sales", "", "", False),
    ("fiscal year gross generation of the complex", "fiscal_year", "gross_generation", "", "complex", False),
    ("2021/2022 annual generation", "fiscal_year", "gross_generation", "", "", True),
    ("In March 2020 the cascade generation", "month", "gross_generation", "", "region", False),
    ("2020-05 output recorded", "month", "unknown", "actual", "", False),
    ("2020年全年完成发电量 100 亿千瓦时，集团合计", "calendar_year", "gross_generation", "actual", "group", True),
    ("预计全年上网电量", "calendar_year", "energy_sent_out", "forecast", "", True),
    ("geração anual da usina foi de 12", "calendar_year", "gross_generation", "actual", "plant", True),
    ("company total output expected", "calendar_year", "unknown", "forecast", "group", False),
    ("province total, actual generation", "calendar_year", "gross_generation", "actual", "region", False),
    ("The weather was mild", "calendar_year", "unknown", "", "", False),
    ("rollingstock came quarterly, generating value", "calendar_year", "unknown", "", "", False),
    ("electricity supplied, as reported, by the hydroelectric scheme", "calendar_year", "energy_sent_out", "actual", "plant", False),
    ("May I ask", "month", "unknown", "", "", False),
    ("", "calendar_year", "unknown", "", "", False),
]

#: unit, kind, GWh of one (negative for none)
UNITS = [
    ("GWh", "energy", 1.0), (" g wh ", "energy", 1.0), ("MWh", "energy", 0.001), ("kWh", "energy", 0.000001), ("TWh", "energy", 1000.0), ("亿千瓦时", "energy", 100.0), ("万千瓦时（含税）", "energy", 0.01),
    ("亿度", "energy", 100.0), ("万度", "energy", 0.01), ("度", "energy", 0.000001), ("千瓦时", "energy", 0.000001), ("兆瓦时", "energy", 0.001),
    ("MW", "power", -1.0), ("kw", "power", -1.0), ("万千瓦", "power", -1.0), ("兆瓦", "power", -1.0), ("wh", "unclear", -1.0), ("hours", "unclear", -1.0), ("", "unclear", -1.0),
]

#: query and path after the host, as they are and as they must be
URLS = [
    ("/a//b/?utm_source=x&q=1#f", "/a/b?q=1"), ("", "/"), ("/", "/"), ("//", "/"), ("/a/", "/a"), ("?q=1", "/?q=1"), (":443/a", "/a"), (":8443/a", ":8443/a"),
    ("/x?spm=1&from=2&source=3", "/x?spm=1&from=2&source=3"), ("/x?mc_cid=1&mc_eid=2&referrer=3&ref=4&a=b", "/x?a=b"), ("/x?FBCLID=1&gclid=2", "/x"), ("/x?b=2&a=1&b=", "/x?b=2&a=1&b="), ("/x?flag", "/x?flag="), ("/x?a=1%202", "/x?a=1+2"), ("/x?&&a=1", "/x?a=1"), ("/x#top", "/x"),
]

#: numbers as written, and their values (negative for none)
NUMBERS = [("1,234.5", 1234.5), ("1.234,5", 1234.5), ("83,5", 83.5), ("83,500", 83500.0), ("1.234.567", 1234567.0), ("12", 12.0), ("0.5", 0.5), ("83.879", 83.879), ("1,234,567", 1234567.0), ("x", -1.0)]

#: text, years in it, joined by commas
YEAR_LISTS = [("{Y}年, {Z}; {Y} and 1{Y}99", "{Y},{Z}"), ("no year", ""), ("12{Y}", ""), ("{Z}/{Y}", "{Z},{Y}"), ("1899, 2100 and 1900-2099", "1900,2099"), ("v{Y}.pdf", "{Y}")]

FACT_TEXTS = [
    "Plant annual generation in {Y} was {V} GWh. Net generation in {Z} was {V} MWh.",
    "The station delivered {V} GWh, reported for {Y}.",
    "In {Y} and {Z} the cascade made {V} MWh overall. Other {V} kWh.",
    "{Y}年发电量预计 {V} 万千瓦时",
    "Installed capacity {V} MW in {Y}.",
    "No figures here.",
    "FY{Y} gross generation {V} TWh",
    "Quarterly note: Q2 {Y} net generation {V} GWh",
    "{Y} annual report of generation; {V} GWh in {Z} or {Y}",
]
#: text, order of the fact, year (Y, Z or '' for none), unit, GWh of one (negative for none), metric, value type, scope, period, flags
FACTS = [
    (0, 0, "Y", "GWh", 1.0, "gross_generation", "", "plant", "calendar_year", ""),
    (0, 1, "Z", "MWh", 0.001, "net_generation", "", "", "calendar_year", ""),
    (1, 0, "Y", "GWh", 1.0, "unknown", "actual", "plant", "calendar_year", "METRIC_UNCLEAR,PERIOD_UNCLEAR"),
    (2, 0, "Z", "MWh", 0.001, "unknown", "", "region", "calendar_year", "METRIC_UNCLEAR,PERIOD_UNCLEAR,SCOPE_NOT_PLANT"),
    (2, 1, "", "kWh", 0.000001, "unknown", "", "", "", "METRIC_UNCLEAR"),
    (3, 0, "Y", "万千瓦时", 0.01, "unknown", "forecast", "", "calendar_year", "METRIC_UNCLEAR,PERIOD_UNCLEAR,FORECAST_SUSPECT"),
    (4, 0, "Y", "MW", -1.0, "unknown", "", "", "calendar_year", "UNIT_NOT_ENERGY,CAPACITY_SUSPECT,METRIC_UNCLEAR,PERIOD_UNCLEAR"),
    (6, 0, "Y", "TWh", 1000.0, "gross_generation", "", "", "fiscal_year", "PERIOD_FISCAL"),
    (7, 0, "Y", "GWh", 1.0, "net_generation", "", "", "quarter", "PERIOD_QUARTER"),
    (8, 0, "Y", "GWh", 1.0, "gross_generation", "", "", "calendar_year", ""),
]

FACT_PAGES = [
    "<table><caption>Stations</caption><tr><th rowspan=2>Station</th><th colspan=2>{Y}</th></tr><tr><th>Generation (GWh)</th><th>Generation change %</th></tr><tr><td>{N} Hydropower Station</td><td>{V}</td><td>3</td></tr><tr><td>Other dam</td><td>55</td><td>1</td></tr></table>",
    "<p>x</p><table><caption>{Y} report</caption><tr><th>Plant</th><th>Output MWh</th><th>Output 第一季度 MWh</th></tr><tr><td>{N}</td><td>{V}</td><td>7</td></tr></table>",
    "<table><tr><td>In {Y} annual generation</td><td>{V} GWh</td></tr></table>",
    "<table><tr><th>Plant</th><th>Season 季度</th></tr><tr><td>{N}</td><td>{V}</td></tr></table>",
    "<p>In {Z} net generation {V} GWh</p><table><tr><th>{N}</th><th>{Y} generation GWh</th></tr><tr><td>{N}</td><td>{V}</td></tr></table>",
    "<p>Full year {Y}, in GWh</p><p>{N} 1 2% {V} -4%</p><p>Another 1 2 3 4</p>",
]
#: page, locator, year, unit, GWh of one, metric, scope: facts of tables
PAGE_FACTS = [
    (0, "table[0].row[0].col[1]", "Y", "GWh", 1.0, "gross_generation", "plant"),
    (1, "table[0].row[0].col[1]", "Y", "MWh", 0.001, "unknown", "plant"),
    (2, "table[0].row[0]", "Y", "GWh", 1.0, "gross_generation", ""),
    (4, "table[0].row[0].col[1]", "Y", "GWh", 1.0, "gross_generation", "plant"),
]


#: status, declared type, body ({B}: a page, {L}: a line end, {BIG}: more than is allowed), expected kind; what is wrong, the kind
FETCHES = [
    (200, "text/html", "{B}", "any", "ok", "html"), (404, "", "{B}", "any", "http_404", "html"), (403, "text/html", "{B}", "any", "http_403", "html"), (429, "", "x", "any", "http_429", "unknown"), (500, "", "x", "any", "http_error", "unknown"),
    (200, "", "", "any", "empty_body", "unknown"), (200, "", "%PDF-1.7 x", "pdf", "ok", "pdf"), (200, "text/html", "{B}", "pdf", "not_pdf", "html"), (200, "", "  %PDF-1.4", "any", "ok", "pdf"), (200, "application/json", "x", "json", "ok", "json"),
    (200, "", "{a: 1}", "any", "ok", "json"), (200, "", "[1, 2]", "csv", "not_expected_type", "json"), (200, "", "a,b{L}1,2", "csv", "ok", "csv"), (200, "", "<html><body>Just a moment please", "any", "html_block_page", "html"),
    (200, "", "<HTML>Access Denied", "any", "html_block_page", "html"), (200, "", "access denied, in plain words", "any", "ok", "unknown"), (200, "text/html", "请稍候", "any", "html_block_page", "html"), (200, "text/csv", "x", "excel", "not_expected_type", "csv"),
    (200, "application/vnd.ms-excel", "x", "excel", "ok", "excel"), (200, "", "PK{C3}{C4}rest", "any", "ok", "excel"), (200, "", "nothing", "any", "ok", "unknown"), (200, "text/html", "{BIG}", "any", "too_large", "html"), (302, "", "x", "any", "http_error", "unknown"), (204, "", "x", "html", "not_expected_type", "unknown"),
    (200, "text/html", "We use Cloudflare", "any", "html_block_page", "html"), (200, "text/html", "please enable JavaScript", "any", "html_block_page", "html"), (200, "text/html", "Unusual traffic", "any", "html_block_page", "html"), (200, "text/html", "人机验证", "any", "html_block_page", "html"),
    (200, "text/html", "Are you a robot?", "any", "html_block_page", "html"), (200, "text/html", "Verifying you are human", "any", "html_block_page", "html"), (200, "text/html", "CAPTCHA", "any", "html_block_page", "html"), (200, "text/html", "403 Forbidden", "any", "html_block_page", "html"),
    (200, "text/html", "请开启 JavaScript", "any", "html_block_page", "html"),
]
#: status (-1: none), declared type, kind of document, end of the address; access and state
PROBES = [
    (200, "text/html", "html", "/x", "reachable", "discovered"), (200, "text/html", "PDF", "/x", "requires_browser", "discovered"), (200, "text/html; charset=utf-8", "", "/x.PDF?y=1", "requires_browser", "discovered"), (200, "application/pdf", "pdf", "/x.pdf", "reachable", "discovered"),
    (301, "", "", "/x", "reachable", "discovered"), (401, "", "", "/x", "requires_browser", "discovered"), (403, "text/html", "pdf", "/x.pdf", "requires_browser", "discovered"), (429, "", "", "/x", "requires_browser", "discovered"),
    (404, "", "", "/x", "unavailable", "unavailable"), (500, "", "", "/x", "unavailable", "unavailable"), (-1, "", "", "/x", "unknown", "unavailable"),
]
#: address, kind of source; reliability
RELIABILITY = [
    ("https://www.iea.org/x", "other", 0.90), ("https://notiea.org/x", "search_result", 0.47), ("http://sub.eia.gov/x", "official", 0.95), ("http://power.gov/x", "official", 1.0), ("https://a.gov.br/x", "authority", 0.92), ("http://b.org.uk/", "authority", 0.85),
    ("https://c.com/", "official", 0.92), ("ftp://c.com/", "other", 0.5), ("http://gov.example.com/", "search_result", 0.40), ("https://nea.gov.cn/", "other", 0.95), ("http://user@ctg.com.cn:80/", "other", 0.90), ("https://iea.org.evil.com/", "unknown", 0.52),
]
#: address, kind of document, what is known of the text; fit ({S}: the name without spaces, {N}: the name)
FITS = [
    ("https://x.com/{Y}/annual-report.pdf", "pdf", "", 0.8), ("https://x.com/{S}-{Y}.pdf", "pdf", "", 0.95), ("https://x.com/a", "html", "", 0.5), ("https://x.com/a", "html", "{N} {Y} GENERATION of electricity in GWh", 0.8),
    ("https://x.com/{Y}", "html", "Electricity", 0.76), ("https://x.com/year-report/{S}/{Y}", "pdf", "gwh", 1.0), ("https://x.com/AnnualReport", "", "nothing", 0.6), ("https://x.com/x.pdf", "pdf", "", 0.55),
]
#: address, kind of document, channel, depth; estimate
GUESSES = [
    ("https://x.gov/a", "pdf", "sitemap", 0, 0.90), ("https://x.gov/a", "html", "sitemap", 0, 0.85), ("https://official.com", "html", "navigation", 2, 0.85), ("https://x.org/a", "pdf", "navigation", 1, 0.85), ("https://x.com/a", "html", "navigation", 1, 0.65),
    ("https://x.com/a.gov", "pdf", "navigation", 3, 0.75), ("https://x.com/", "html", "sitemap", 1, 0.7), ("https://x.edu/", "html", "search", 0, 0.75), ("https://government.com/", "pdf", "search", 0, 0.95), ("https://wikipedia.com/", "html", "search", 0, 0.70),
    ("https://x.com/", "pdf", "search", 0, 0.6), ("https://official.net/", "html", "search", 0, 0.75),
]
#: names joined by |; aliases joined by |
ALIASES = [
    ("Three Gorges Dam Hydroelectric Station|三峡水电站", "Three Gorges Dam Hydroelectric Station|three|gorges|Three Gorges|三峡水电站|三峡电站"), ("Itaipu Binacional", "Itaipu Binacional|itaipu|binacional"), ("长江葛洲坝水电厂", "长江葛洲坝水电厂|葛洲坝水电厂|葛洲坝电站"),
    (" Belo Monte Power Plant ||Ab", "Belo Monte Power Plant|belo|monte|Belo Monte"), ("Atatürk HES", "Atatürk HES|atatürk"), ("", ""), ("Rio", "Rio"),
]
#: name, standard name, operator, country, known domain, fiscal year, metric; the phrases joined by |; a failure ('' for none), what was tried, the next phrases
PHRASED = [
    ("Hoover Dam", "Hoover Dam", "USBR", "United States", "", False, "generation", "\"Hoover Dam\" {Y} annual generation|\"Hoover Dam\" {Y} annual report generation|\"USBR\" {Y} annual report \"Hoover Dam\" generation", "no results", "", "\"Hoover Dam\" {Y} annual generation filetype:pdf|\"Hoover Dam\" {Y} operating statistics report"),
    ("Hoover Dam", "Hoover", "", "United States", "www.USBR.gov", True, "generation", "\"Hoover Dam\" {Y} fiscal year annual generation|\"Hoover\" {Y} fiscal year annual report generation|site:usbr.gov \"Hoover Dam\" {Y} annual generation", "all IRRELEVANT", "x", "\"Hoover Dam\" {Y} fiscal year annual report generation|site:usbr.gov \"Hoover Dam\" {Y} annual generation"),
    ("三峡电站", "三峡电站", "长江电力", "China", "", False, "generation", "三峡电站 {Y} 完成发电量|三峡电站 {Y} 全年 发电量|长江电力 {Y} 发电量完成情况公告", "empty", "三峡电站 {Y} 年度报告 发电量", "三峡电站 {Y} 公告 全年 发电量 pdf"),
    ("三峡电站", "三峡电站", "", "China", "", True, "generation", "三峡电站 {Y} 财政年度 完成发电量|三峡电站 {Y} 财政年度 全年 发电量|三峡电站 {Y} 财政年度 发电量 年度报告", "不相关", "", "三峡电站 {Y} 财政年度 发电量 年度报告"),
    ("Usina Hidrelétrica Itaipu", "Itaipu", "", "Brazil", "", False, "generation", "Itaipu {Y} geração anual|Itaipu {Y} relatório anual geração", "HTTP 429", "", ""),
    ("Atatürk", "Atatürk", "DSI", "Türkiye", "", False, "generation", "\"Atatürk\" {Y} yıllık elektrik üretimi|\"Atatürk\" {Y} yıllık faaliyet raporu üretim|\"DSI\" {Y} yıllık üretim raporu \"Atatürk\"", "irrelevant", "\"Atatürk\" {Y} yıllık faaliyet raporu üretim", "\"DSI\" {Y} yıllık üretim raporu \"Atatürk\""),
    ("Aswan", "Aswan", "", "Egypt", "", False, "generation", "\"Aswan\" {Y} إنتاج الكهرباء السنوي|\"Aswan\" {Y} التقرير السنوي إنتاج الكهرباء", "", "", ""),
    ("Belo Monte", "Belo Monte Dam", "Norte Energia", "Brazil", "www.norte.example", True, "capacity", "\"Belo Monte\" {Y} fiscal year installed capacity MW|\"Belo Monte Dam\" {Y} fiscal year capacity report|site:norte.example \"Belo Monte\" {Y} capacity report", "nothing", "", "\"Belo Monte\" {Y} filetype:pdf installed capacity|\"Belo Monte\" {Y} official capacity data"),
    ("Belo Monte", "Belo Monte", "", "Peru", "", False, "capacity", "\"Belo Monte\" {Y} installed capacity MW|\"Belo Monte\" {Y} capacity report", "ineligible", "", ""),
]
#: text, kind of period asked for; reason, score, scope, the word that tells it ('' for none), what shows it ('' for none, {T}: the whole text); {F}: many words that say nothing
RELEVANCES = [
    ("{N}: annual generation in {Y} was {V} GWh", "calendar_year", "confirmed", 1.0, "annual", "annual", "{T}"), ("{N}: annual generation in {Y} was {V} GWh", "fiscal_year", "unclear_period", 0.0, "annual", "annual", "{T}"),
    ("Another dam: annual generation in {Y}", "calendar_year", "no_name", 0.0, "annual", "annual", "{T}"), ("{N} annual generation", "calendar_year", "no_year", 0.0, "annual", "annual", "{T}"), ("{N} in {Y}: a fine view", "calendar_year", "no_year", 0.0, "unknown", "", ""),
    ("{N} energia gerada no primeiro trimestre, {Y}", "calendar_year", "partial_period", 0.0, "partial", "trimestre", "{T}"), ("{N} fiscal year {Y}: electricity generation of {V} GWh", "calendar_year", "fiscal_period", 0.0, "fiscal_year", "fiscal year", "{T}"),
    ("{N} fiscal year {Y}: electricity generation of {V} GWh", "fiscal_year", "confirmed", 1.0, "fiscal_year", "fiscal year", "{T}"), ("{N} 招标: {Y} 发电量", "calendar_year", "excluded", 0.0, "unknown", "", "{T}"),
    ("{N} annual report, 招标: full year {Y} electricity generation", "calendar_year", "confirmed", 1.0, "annual", "annual", "{T}"), ("{N} electricity generation of {Y}", "calendar_year", "unclear_period", 0.0, "unknown", "", "{T}"),
    ("{N} gerou {V} GWh em {Y}, notícia de 5 de maio de 1984", "calendar_year", "confirmed", 1.0, "annual", "em {Y}", "{T}"), ("{N} gerou {V} GWh em janeiro de {Y}", "calendar_year", "partial_period", 0.0, "partial", "em janeiro", "{T}"),
    ("{Y}年发电量完成情况公告：全年发电量 {V}", "disclosure", "disclosure", 0.72, "annual", "全年", "{T}"),
    ("{N} produced much. {F} In {Y} the {N} plant, for the full year, generated {V} GWh. Then it rained.", "calendar_year", "confirmed", 1.0, "annual", "full year", "{Y} the {N} plant, for the full year, generated {V} GWh. Then it rained."),
    ("{N} produced much in the first trimestre. {F} {Y}年{N}全年发电量 {V}。后来。", "calendar_year", "confirmed", 1.0, "annual", "全年", "{Y}年{N}全年发电量 {V}。"),
    ("{N} generated {V} GWh in {Z}/{Y}. {F} It was generated for the year.", "fiscal_year", "confirmed", 1.0, "fiscal_year", "{Z}/{Y}", "{N} generated {V} GWh in {Z}/{Y}."), ("The defyant {N} produced {V} GWh of {Y}", "fiscal_year", "unclear_period", 0.0, "unknown", "", "{T}"),
    ("{N} produced {V}. {F} Annual figures of {Y}.", "calendar_year", "no_year", 0.0, "unknown", "", "Annual figures of {Y}."), ("", "calendar_year", "no_name", 0.0, "unknown", "", ""),
]
#: Words that say nothing, to part what stands before and after them by some 1,200 characters.
FILLER = "calm water lay beside old stone walls and birds " * 25


#: text of FACT_TEXTS, order of the fact, its sentence
SENTENCES = [
    (0, 0, "Plant annual generation in {Y} was {V} GWh."), (0, 1, "Net generation in {Z} was {V} MWh."), (1, 0, "The station delivered {V} GWh, reported for {Y}."), (2, 0, "In {Y} and {Z} the cascade made {V} MWh overall."), (2, 1, "Other {V} kWh."),
    (3, 0, "{Y}年发电量预计 {V} 万千瓦时"), (4, 0, "Installed capacity {V} MW in {Y}."), (6, 0, "FY{Y} gross generation {V} TWh"), (7, 0, "Quarterly note: Q2 {Y} net generation {V} GWh"), (8, 0, "{Y} annual report of generation; {V} GWh in {Z} or {Y}"),
]
#: a model's answer ({V}: a number), whether it keeps to the contract, flags of its candidates
ANSWERS = [
    ('{"candidates": [{"period_label": "2020", "period_type": "calendar_year", "generation_gwh": {V}, "metric": "gross_generation", "unit_raw": "GWh", "snippet": "annual generation"}]}', True, "LLM_SOURCED"),
    ('{"candidates": [{"generation_gwh": {V}, "bogus": 1}]}', False, ""), ('{"candidates": [', False, ""), ('{"candidates": [], "note": "x"}', False, ""), ('{"candidates": []}', True, ""), ('{}', True, ""),
    ('{"candidates": [{"generation_gwh": -{V}}]}', False, ""), ('{"candidates": [{"confidence": 1.5}]}', False, ""), ('{"candidates": [{"metric": "heat"}]}', False, ""), ('[]', False, ""), ('{"candidates": [{"generation_gwh": "many"}]}', False, ""),
    ('{"candidates": [{"value_type": "forecast", "measurement_scope": "group", "unit_raw": "MW", "period_type": "calendar_year", "period_label": "2020"}]}', True, "LLM_SOURCED,FORECAST_SUSPECT,SCOPE_NOT_PLANT,METRIC_UNCLEAR,UNIT_NOT_ENERGY,CAPACITY_SUSPECT,PERIOD_UNCLEAR"),
]
#: locator; page (negative for none), table
LOCATORS = [
    ("page[3].table[1].row[4].col[2]", 3, "table[1].row[4].col[2]"), ("page[12].ocr", 12, ""), ("table[0].row[2]", -1, "table[0].row[2]"), ("text", -1, ""), ("see page 4 of table 2", -1, ""), ("x page[7]", 7, ""), ("PAGE[5].TABLE[2]", 5, "TABLE[2]"), ("page[3-4].table[1]", -1, "table[1]"),
]


#: country of the entity, address, text; why they do not go together ('' if they do)
HOMES = [
    ("US", "https://www.eia.gov/x", "", ""), ("CN", "https://www.eia.gov/x", "", "source_country"), ("CN", "https://a.cn/x", "中国 dam", ""), ("BR", "https://a.cn/x", "", "source_country"), ("BR", "https://aneel.gov.br/x", "", ""), ("FR", "https://aneel.gov.br/x", "", "source_country"),
    ("US", "https://worldbank.org/x", "A dam in China", "text_country"), ("US", "https://worldbank.org/x", "China and the USA", ""), ("CN", "https://worldbank.org/x", "An American dam", "text_country"), ("BR", "https://worldbank.org/x", "of the United States", "text_country"),
    ("BR", "https://worldbank.org/x", "Chinese firm in Brasil", ""), ("FR", "https://worldbank.org/x", "A dam in China", ""), ("US", "https://worldbank.org/x", "", ""), ("US", "https://stats.gov.cn/", "", "source_country"),
]


#: names joined by |, text with rows of stations
ROW_TEXTS = [
    ("长江三峡水电站|{N}", "2020年发电量情况：全年 亿千瓦时 电站 {N} 1.5 2% {V} -3.1% 三峡电站 12 1 {V}.5 4 合计 1 2 3 4"),
    ("{N} Dam", "Annual generation, GWh, {Y} {N} 10 -2.5 {V} 3.4% Old{N} 1 2 77 4 {N}x 1 2 88 4 {N} Dam 5 6 {V} 7"),
    ("{N}|{N} station", "{N} station 1 2 {V} 3 full year MWh"),
    ("{N}", "{N} 10 -2.5 {V} 3.4 of {Y} in GWh"),
    ("{N}", "Full year, {Y}: {N} 10 -2.5 {V} 3.4"),
    ("", "Full year, GWh {Y}: {N} 10 -2.5 {V} 3.4"),
    ("Belo Monte Power Plant|{N}", "Full year {Z}, MWh.\n\nBelo Monte  1,5\t-20%  {V}  +  then Belo Monte 1 2 {V} 4 and {N} 9 8 {V}.25 6; {N} 9 8 7"),
    ("Unit|Unit 7", "annual report {Y} kWh Unit 7 1 2 {V} 4"),
]
#: case, order, station, year, value, unit, GWh of one
ROW_FACTS = [
    (0, 0, "{N}", "2020", "{V}", "亿千瓦时", 100.0), (0, 1, "三峡电站", "2020", "{V}.5", "亿千瓦时", 100.0),
    (1, 0, "{N} Dam", "Y", "{V}", "GWh", 1.0),
    (6, 0, "{N}", "Z", "{V}.25", "MWh", 0.001), (6, 1, "Belo Monte", "Z", "{V}", "MWh", 0.001),
    (7, 0, "Unit 7", "Y", "{V}", "kWh", 0.000001), (7, 1, "Unit", "Y", "2", "kWh", 0.000001),
]


#: case, page, text of a page with its layout
LAYOUT_PAGES = [
    (0, 1, "Report\nStation   Generation\n  Name      GWh\n{N}  {V}   \nOther  1,5\n\nfoot"), (0, 2, "Station  Generation\nName  GWh\nThird\t{V}"),
    (1, 1, "Station  {Y} GWh\n{N}  {V}"), (1, 2, "Station  {Z} GWh\n{N}  {V}"),
    (2, 1, "Year  Output MWh\n{Y}  {V}"), (2, 2, "{N}  {V}\nplain words here\n{N} a  {V}\n{N} b  {V}"), (2, 3, "Quarter Q2 notes\n{N}  {V}"), (2, 4, "{N}  {V}"),
    (3, 1, "Just text.\nNo  table words\n"), (3, 2, "Station  GWh\n{N}  {V}"), (3, 4, "Station  GWh\n{N}  {V}"), (3, 5, "{N}  {V}\n{N}  only words"), (3, 6, "name  1\n{N} c  2"),
    (4, 1, "Station  GWh\n{N}  {V}\n\nStation  Output  GWh\n{N}  1"), (4, 2, "Station  Output\n{N}  {V}"), (4, 3, "Stations  Output\n{N}  {V}"),
    (5, 1, ""), (5, 2, "Station  GWh"), (5, 3, "alpha  1\nbeta  2"),
]
#: case, first page, last page, headers, rows
LAYOUT_TABLES = [
    (0, 1, 2, "Station Name|Generation GWh", "{N}|{V};Other|1,5;Third|{V}"), (1, 1, 1, "Station|{Y} GWh", "{N}|{V}"), (1, 2, 2, "Station|{Z} GWh", "{N}|{V}"), (2, 1, 2, "Year|Output MWh", "{Y}|{V};{N} a|{V};{N} b|{V}"),
    (3, 2, 2, "Station|GWh", "{N}|{V}"), (3, 4, 6, "Station|GWh", "{N}|{V};{N}|{V};{N} c|2"), (4, 1, 1, "Station|GWh", "{N}|{V}"), (4, 1, 1, "Station|Output|GWh", "{N}|1|"), (4, 2, 2, "Station|Output", "{N}|{V}"), (4, 3, 3, "Stations|Output", "{N}|{V}"),
]
#: case, page before, page, reasons (of pages that do not go on the page before is 0)
LAYOUT_NOTES = [(1, 1, 2, "year_changed"), (2, 0, 3, "period_changed"), (4, 1, 2, "column_count_changed,unit_changed"), (4, 2, 3, "header_changed")]


def values(rows: list[tuple] | list[str], *names: str) -> str:
    """A numbered VALUES table that Spark and DuckDB both read."""

    def cell(x) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"cast({x!r} AS double)" if isinstance(x, float) else str(x)

    lines = ",".join(f"({i}, {', '.join(map(cell, r if isinstance(r, tuple) else (r,)))})" for i, r in enumerate(rows))
    return f"(SELECT * FROM (VALUES {lines}) v(k, {', '.join(names)}))"
