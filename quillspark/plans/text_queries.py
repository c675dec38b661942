"""Queries of text functions, predicates and importers: the plan and its SQL, side by side.

Where a function needs certain forms, a few written samples are dealt over the rows of a table; the
expected results stand in the SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters, json_repair, text
from ..operators import curation
from ..sources import importers
from . import views
from .queries import _DOT, _HTML, _WS, _sql_replaced, at, query
from .views import NOTES_SQL, table


def _quoted(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def dealt(cases: list[tuple]) -> tuple[list, str]:
    """Samples, and SQL of the results that they are to have, dealt over the customers."""
    return [c[0] for c in cases], f"SELECT c_custkey AS id, CASE c_custkey % {len(cases)} " + " ".join(f"WHEN {i} THEN {_quoted(c[1])}" for i, c in enumerate(cases)) + " END AS result FROM customer"


def _sampled(spark, d, samples: list, result) -> DataFrame:
    n = F.col("c_custkey")
    value = F.element_at(F.array(*[F.lit(s).cast("string") for s in samples]), (1 + n % len(samples)).cast("int"))
    return table(spark, d, "customer").select(n.alias("id"), value.alias("v")).select("id", result(F.col("v")).alias("result"))


def samples(name: str, cases: list[tuple], result) -> None:
    """Register a query that applies a function to samples."""
    values, sql = dealt(cases)

    def run(spark, d):
        return _sampled(spark, d, values, result)

    run.__name__, run.__module__ = name, __name__
    query(sql)(run)


def _list(c: Column) -> Column:
    return F.array_join(c, "|")


# ---- rules ------------------------------------------------------------------------------------

samples("junk_topics", [
    ("AI", False), ("x", True), (" ", True), (None, True), ("PROJ-123", True), ("proj-123", False), ("max_tokens", True), ("Max_Tokens", False), ("Q3 2024", True), ("2024 q1", True), ("H2", True), ("2024-1-5", True), ("1/2/24", True),
    ("notes.md", True), ("notes.doc", False), ("./run", True), ("src/lib/util.ts", True), ("Build / Buy", False), ("£50/month", False), ("£50", True), ("1,200.5k", True), ("45%", True), ("5-licence pack", True), ("20,000 -credit", True),
    ("The Meeting", True), ("daily standup", True), ("vector search", False), ("Rate Books", True), ("machine learning", False),
], curation.is_junk_topic)

samples("note_secrets", [
    ("key sk-or-v1-" + "a1" * 10, "OpenAI/OpenRouter API key"), ("eyJ" + "a" * 20 + "." + "b" * 20, "JWT token"), ("ghp_" + "A" * 36, "GitHub token"), ("gho_" + "A" * 36, "GitHub OAuth token"), ("x AKIA" + "Z" * 16, "AWS access key"),
    ("sbp_" + "0" * 20, "Supabase key"), ("-----BEGIN RSA PRIVATE KEY-----", "Private key block"), ("-----BEGIN PRIVATE KEY-----", None), ("API_KEY = 'abcdefghijklmnop'", "Generic secret assignment"), ("token: short", None),
    ("Postgres://u:p@h", "Connection string with credentials"), ("postgresql://u:p@h", None), ("password=" + "x" * 16 + " ghs_" + "A" * 36, "GitHub token"), ("nothing", None),
], curation.first_secret)

samples("automatic_mail_senders", [
    ("NoReply@x.org", True), ("no.reply@x.org", True), ("automated@x.org", True), ("newsletter@x.org", False), ("ann@x.org", False), (None, False), ("Mailer-Daemon@x", True), ("postmaster@x", True), ("notify@x.org", False),
], lambda c: importers.is_automatic_mail(c, F.lit("hello"), F.lit("text")))

samples("automatic_mail_subjects", [
    ("Your receipt", True), ("Receipts", False), ("your order is here", True), ("order", False), ("Confirmation # 12", True), ("Password Reset", True), ("verify your email", True), ("Payment due", True), ("a request $12.50", True),
    ("Unsubscribe", True), ("please unsubscribe", False), ("Out of office", False), (None, False), ("autopay set", True), ("requests 12", False),
], lambda c: importers.is_automatic_mail(F.lit("ann@x.org"), c, F.lit("text")))

samples("automatic_mail_bodies", [
    ("Ann reacted via Gmail", True), ("This message was automatically generated.", True), ("a {b} c", False), ("{a}" * 11, True), ("{a}" * 10, False), ("{" * 20, False),
], lambda c: importers.is_automatic_mail(F.lit("ann@x.org"), F.lit("hi"), c))

samples("automatic_mail_header", [("auto-replied", True), ("No", False), ("", False), (None, False)], lambda c: importers.is_automatic_mail(F.lit("ann@x.org"), F.lit("hi"), F.lit("x"), c))

samples("search_titles", [
    ("How many r's", "trivia_title"), ("What day is it", "trivia_title"), ("what days", None), ("when does it open", "trivia_title"), ("spell cat", "trivia_title"), ("spell cat and dog", None), ("convert 32 f to c", "trivia_title"), ("convert 32f to c", None), ("32 degrees", "trivia_title"),
    ("5 + 3", "trivia_title"), ("define x", "trivia_title"), ("Translate this", "trivia_title"), ("what does x mean?", "trivia_title"), ("what does it all mean in the end of things", None), ("image.png", "trivia_title"), ("images of cats", None), (None, None), ("pronounce it", "trivia_title"),
], lambda c: importers.junk_reason(c, F.lit("a" * 400)))

samples("search_answers", [("", "empty_answer"), ("  ", "empty_answer"), (None, "empty_answer"), ("a" * 399, "short_answer"), ("a" * 400, None)], lambda c: importers.junk_reason(F.lit("deep question"), c))

samples("activity_noise", [
    ("Maps:Visited the big museum of art", True), ("Maps:Searched for x y z", False), ("Maps:A short place name", True), ("Maps:" + "a" * 30, False), ("YouTube:Watched a cat", True), ("YouTube:Watched " + "a" * 40, False), ("YouTube:Visited a channel page", True),
    ("Chrome:12345678901234", True), ("Chrome:123456789012345", False), ("Search:short", True), ("Search:3 notifications came", True), ("Search:how to bake bread", False), ("Maps:Navigating to work", False), ("Maps:Opened the map app", True),
], lambda c: importers.is_activity_noise(F.split_part(c, F.lit(":"), F.lit(1)), F.substring_index(c, ":", -1)))

samples("chat_parts", [
    ("text/ a |b", "a \nb"), ("thoughts/a", None), ("tether_quote/a", None), ("code/see ```x\ny``` here", "see  here"), ("execution_output/<<ImageDisplayed>>", ""), ("execution_output/42", "42"), ("tether_browsing_display/x【4†source】 y", "x y"),
    ("sonic_webpage/ignored", "snip"), ("multimodal_text/a", "a\nspoken"), ("odd_kind/z", "z"),
], lambda c: importers.part_text(F.split_part(c, F.lit("/"), F.lit(1)), F.split(F.regexp_replace(c, "^[a-z_]+/", ""), r"\|"), F.array(F.lit("spoken")), F.lit(" snip【1†a】")))

samples("conversation_skips", [
    ("5|t|100|1|0|10|0", "already_imported"), ("5|t|100|1|1|10|0", None), ("5|t|100|0|0|1|0", "before_date_filter"), ("5|t|100|0|0|30|0", "after_date_filter"), ("5|t|100|0|0|10|1", "do_not_remember"), ("1|t|100|0|0|10|0", "single_turn"), ("10||1|0|0|10|0", None),
    ("5||100|0|0|10|0", "untitled_short"), ("6||100|0|0|10|0", None), ("6||49|0|0|10|0", "too_little_text"), ("5|t|49|0|0|10|0", "too_little_text"), ("1|t|1|1|0|1|1", "already_imported"),
], lambda c: _skip(F.split(c, r"\|")))


def _skip(p: Column) -> Column:
    from datetime import date

    words, day = F.repeat(F.lit("w "), p[2].cast("int")), F.date_add(F.lit(date(2024, 1, 1)), p[5].cast("int"))
    return importers.skip_reason(p[0].cast("int"), p[1], words, p[3] == "1", p[4] == "1", day, date(2024, 1, 5), date(2024, 1, 20), p[6] == "1")


samples("newsletter_names", [
    ("Newsletter — Some Weekly / issue 3", "A:Some Weekly"), ("**Newsletter - Daily. text", "A:Daily"), ("Title (Deep Notes, 12 May 2024) text", "B:Deep Notes"), ("Title (Year 2023 Notes, 2024-05-12)", None), ("Source: Long Reads (longreads.substack.com)", "C:Long Reads"), ("plain text", None), (None, None),
    ("Book (Author, Chapter 3)", "B:Author"),
], lambda c: F.when(text.newsletter(c).isNotNull(), F.concat(text.newsletter(c)["pattern"], F.lit(":"), text.newsletter(c)["publisher"])))

_KNOWN = {"Blue Weekly": ["Ann Blue", "Ann"], "Red": []}
samples("publisher_names", [("ann blue", "Blue Weekly"), ("ANN", "Blue Weekly"), ("red", "Red"), ("The Red Paper", "Red"), ("Other", "Other"), (" Blue Weekly ", "Blue Weekly")], lambda c: text.canonical_publisher(c, _KNOWN))
samples("publisher_worth", [("Blue weekly", True), ("My Newsletter", True), ("Some Thing", False), ("A et al Newsletter", False), ("Ann × Bob Substack", False), ("Newsletter 2024", False), ("8 May Newsletter", False), ("Newsletter — part", False), ("N" * 61, False), (" ", False)], lambda c: text.worth_a_newsletter(c, _KNOWN))

samples("trivial_messages", [("ok", True), ("Thank you.", True), (" TY ", True), ("okay then", False), ("no", True), ("", False), ("nope.", True)], text.is_trivial)

samples("unsafe_texts", [
    ("-----BEGIN RSA PRIVATE KEY-----", "private_key"), ("sk-" + "a" * 20, "api_key"), ("Password: " + "x" * 12, "credential_like_string"), ("```" * 4, "large_code_block"), ("\n".join(["x" * 121] * 21), "large_code_block"), ("\n".join(["user: hi"] * 9), "raw_transcript_like"),
    ("plain", ""), ("\n".join(["user: hi"] * 8), ""), ("secret=" + "y" * 12 + " sk-" + "b" * 20, "api_key|credential_like_string"), ("z" * 15001, "raw_transcript_like"),
], lambda c: _list(text.unsafe_reasons(c)))

# ---- text functions ---------------------------------------------------------------------------

samples("tier_resolution", [("standard/personal", "personal"), ("personal/standard", "personal"), ("standard/odd", "personal"), ("restricted/personal", "restricted"), ("standard/", "standard"), ("personal/ RESTRICTED ", "restricted")], lambda c: text.resolved_tier(F.split_part(c, F.lit("/"), F.lit(1)), F.split_part(c, F.lit("/"), F.lit(2))))

samples("tier_reasons", [("ssn 123-45-6789 password: x", "ssn_pattern"), ("salary 5000 and aspirin", "drug_name|financial_detail"), ("plain", ""), ("take 5 mg", "medication_dosage"), ("5 mg/dL", ""), (None, ""), ("password: x", "password_value")], lambda c: _list(text.sensitivity_reasons(c)))

samples("structured_captures", [
    ("[Idea] [AI] try it + ask Bob", "idea/AI/try it Next step: ask Bob/ask Bob"), ("[note][x]body", "reference/x/body/"), ("[odd] [x] body", "/x/body/"), ("no form", "//no form/"), ("[task] [t] a\nb", "//[task] [t] a\nb/"), ("[Person Note] [y] z", "person_note/y/z/"),
], lambda c: F.concat_ws("/", *[F.coalesce(text.structured_capture(c)[k], F.lit("")) for k in ("type_hint", "topic_hint", "text", "next_step")]))

samples("type_aliases", [("Action", "task"), ("follow-up", "task"), ("TODO", "task"), ("people", "person_note"), ("journal entry", "journal"), ("policy", "decision"), ("odd", "idea"), (None, "idea"), ("Fact", "reference"), ("warning", "lesson"), ("session", "meeting"), ("meeting", "meeting")], text.canonical_type)

samples("string_lists", [(" a ,,b,a", "a|b"), ("", ""), (",".join("abcdefghijklmn"), "a|b|c|d|e|f|g|h|i|j|k|l"), (",".join("aaaaaaaaaaaab"), "a")], lambda c: _list(text.string_list(F.split(c, ","))))

samples("evergreen_tags", [("x/an Evergreen note", "x|evergreen"), ("Evergreen/evergreen", "Evergreen"), ("x/evergreens", "x"), ("/evergreen", "evergreen")], lambda c: _list(text.with_evergreen(F.split(F.split_part(c, F.lit("/"), F.lit(1)), ","), F.split_part(c, F.lit("/"), F.lit(2)))))

samples("previews", [("  a\t b  \nc", "a b"), ("x" * 100, "x" * 80), ("", "")], text.preview)
samples("shortened_texts", [("x" * 21, "x" * 17 + "..."), ("x" * 20, "x" * 20)], lambda c: text.shortened(c, 20))
samples("clean_names", [(" A\x01 B ", "A B"), ("x" * 210, "x" * 200), ("a\t\tb", "a b")], text.clean_name)
samples("loose_names", [("Foo-Bar_baz  x!", "foo bar baz x"), ("A.B.", "a.b"), ("  Q; ", "q")], text.loose_name)
samples("name_hues", [("", 0), ("a", 97), ("ab", 3105 % 360), ("abc", 96354 % 360), ("hello", 99162322 % 360)], text.hue)
samples("importance_values", [("0", 3), ("3", 3), ("2.5", 3), ("5", 5), ("40", 2), ("90", 5), ("50", 3), ("-1", 3), (None, 3), ("6", 1), ("100", 5)], lambda c: text.importance_from(c.cast("double")))
samples("capture_gates", [("8/0.75/1", True), ("7/0.75/1", False), ("8/0.5/0", True), ("8/0.51/0", False), ("9/0.5/0", True)], lambda c: text.gate(F.split(c, "/")[0].cast("double"), F.split(c, "/")[1].cast("double"), F.split(c, "/")[2] == "1"))
samples("token_loops", [("start " + "abcd" * 8, True), ("abcd" * 7, False), ("abc" * 20, True), ("a fine text", False), ("x" * 33, True)], text.has_token_loop)
samples("heading_pieces", [("short text", 1), ("# A\n" + "w " * 300 + "\n## B\n" + "v " * 300, 2), ("# A\n" + "w " * 600 + "\n## B\nfew words", 1)], lambda c: F.size(text.heading_chunks(c)))
samples("message_pieces", [("a" * 25, "aaaaaaaaaa|aaaaaaaaaa|aaaaa"), ("aaaa bbbb cccc", "aaaa bbbb|cccc"), ("aaaaaa\nbb cc", "aaaaaa|bb cc"), ("short", "short")], lambda c: _list(text.limited_chunks(c, 10)))
samples("line_items", [("- one longer line\n2. two longer line\nshort\n* three longer", "one longer line|two longer line|three longer"), ("", "")], lambda c: _list(text.line_items(c)))
samples("citation_lists", [("a [#3] b [#12] [#3]", "3|12"), ("none [#x]", "")], lambda c: _list(text.citations(c).cast("array<string>")))
samples("page_link_lists", [("/wiki?slug=a-b x /wiki?slug=c", "a-b|c"), ("/wiki?s=a", "")], lambda c: _list(text.page_links(c)))
samples("id_reference_lists", [("see 0A0b0c0d-0000-1111-2222-333344445555 and #12", "0a0b0c0d-0000-1111-2222-333344445555"), ("none", "")], lambda c: _list(text.id_references(c)))
samples("wiki_links", [("[[A b|x]] [[C#d]] [[A b]]", "A b|C"), ("none", "")], lambda c: _list(text.wikilinks(c)))
samples("inline_tag_lists", [("#one `#two` (#three) a#four\n```\n#five\n```", "one|three"), ("# head", "")], lambda c: _list(text.inline_tags(c)))
samples("json_repairs", [('{"a": [1, 2,], }', '{"a": [1, 2]}'), ('```json\n{"a":1}\n```', '{"a":1}'), ('{"a":[1,2', '{"a":[1,2]}'), ("not json", None), ('{"a":"]"', '{"a":"]"}')], text.repaired_json)
samples("export_times", [("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("2024-01-02 03:04:05", "2024-01-02 03:04:05"), ("2024-01-02", "2024-01-02 00:00:00"), ("01/02/2024", "2024-01-02 00:00:00"), ("01/02/2024 10:00:00", "2024-01-02 10:00:00"), ("2024-01-02T03:04:05+02:00", "2024-01-02 01:04:05"), ("odd", None)], lambda c: text.parsed_timestamp(c).cast("string"))
samples("chat_times", [("/1704164645000", "2024-01-02 03:04:05"), ("2024-01-02/5", "2024-01-02 00:00:00"), ("/x", None)], lambda c: importers.number_or_date(F.split_part(c, F.lit("/"), F.lit(1)), F.split_part(c, F.lit("/"), F.lit(2))).cast("string"))
samples("relative_times", [("10", "just now"), ("2000", "33m ago"), ("7200", "2h ago"), ("172800", "2d ago"), ("864000", "20 Dec"), ("31536000", "30 Dec 2022"), (None, "")], lambda c: _ago(c))
samples("hashtags", [("#a|b|#9|#ok_1/x-y|#", "#a|#ok_1/x-y"), ("", "")], lambda c: _list(text.hashtags(F.split(c, r"\|"))))
samples("mail_bodies", [("SGVsbG8_", "Hello?"), ("SGk-", "Hi>")], importers.mail_body)
samples("own_words_of_mail", [("hi\n> old\nbye\n-- \nsig", "hi\nbye"), ("yes\nOn Monday Ann wrote:\n> x", "yes"), ("a\n---- Original Message ----\nb", "a"), ("plain", "plain")], importers.without_quotes)
samples("repaired_letters", [("cafÃ©", "café"), ("café", "café"), ("日本", "日本"), ("plain", "plain")], importers.repaired_encoding)
samples("export_flags", [("TRUE", True), ("1", True), ("yes", True), ("no", False), ("", False)], importers.flags)
samples("profile_texts", [("x", "Favorite Food: a, b. Home: c.")], lambda c: importers.profile_sentences(F.create_map(F.lit("home"), F.array(F.lit("c")), F.lit("favorite_food"), F.array(F.lit("a"), F.lit("b")), F.lit("none"), F.array().cast("array<string>"))))
samples("payload_precedence", [("a/b/c", "a"), ("/b/c", "b"), (" / /c", "c"), ("//", "d")], lambda c: text.prepared_payload(*[F.split_part(c, F.lit("/"), F.lit(i)) for i in (1, 2, 3)], F.lit("d")))
samples("confidence_scores", [("0.5", 55), ("1.5", 90), ("0", 20), (None, 59), ("0.72", 70)], lambda c: text.confidence_quality(c.cast("double")))
samples("layer_steps", [("", "rhythm"), ("rhythm", "decisions"), ("rhythm,decisions,friction", "dependencies"), ("rhythm,decisions,dependencies,knowledge,friction", "review")], lambda c: curation.next_layer(F.split(c, ","), ("rhythm", "decisions", "dependencies", "knowledge", "friction")))
samples("haystacks", [("Red green/blue", True), ("red/x", False), ("BLUE/red", True)], lambda c: text.holds_words([F.split_part(c, F.lit("/"), F.lit(1)), F.split_part(c, F.lit("/"), F.lit(2))], "red Blue"))
samples("keyword_tiers", [("my SSN is private", "restricted/pii_keyword,privacy_marker"), ("a health note", "personal/medical_keyword"), ("hello", "standard/"), ("the key", "restricted/credential_keyword"), ("keys", "standard/"), ("Internal only", "personal/privacy_marker")], lambda c: F.concat_ws("/", text.keyword_tier(c), F.array_join(text.keyword_reasons(c), ",")))
samples("child_atom_ids", [("a|b|c", "7-split-0:0/3|7-split-1:1/3|7-split-2:2/3"), ("a", "7-split-0:0/1")], lambda c: _list(F.transform(text.child_atoms(F.lit(7), F.split(c, r"\|")), lambda a: F.concat(a["id"], F.lit(":"), a["split_index"].cast("string"), F.lit("/"), a["split_total"].cast("string")))))
samples("web_queries", [("red blue", True), ('"red blue"', False), ("red -green", False), ("pink or green", True), ("pink", False), ("", False), ('"green red"', True), ("-pink", True)], lambda c: F.coalesce(*[F.when(c.eqNullSafe(F.lit(q)), filters.word_query(q, F.array(*map(F.lit, ("green", "red", "and", "blue"))))) for q in ("red blue", '"red blue"', "red -green", "pink or green", "pink", "", '"green red"', "-pink")]))
samples("import_windows", [("24h", "2024-01-08 00:00:00"), ("7d", "2024-01-02 00:00:00"), ("1y", "2023-01-09 00:00:00"), ("all", None)], lambda c: F.coalesce(*[F.when(c == w, importers.since(w, at("2024-01-09 00:00:00")).cast("string")) for w in ("24h", "7d", "1y")]))


def _ago(c: Column) -> Column:
    now = F.lit("2023-12-30 12:00:00").cast("timestamp")
    return text.relative_time(F.timestamp_seconds(F.unix_timestamp(now) - c.cast("bigint")), now)


# ---- whole tables -----------------------------------------------------------------------------

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS w, generate_subscripts({_WORDS}, 1) AS p FROM documents), k AS (SELECT * FROM w WHERE w IN ('the', 'that')),
l AS (SELECT *, max(CASE WHEN w = 'the' THEN p END) OVER o AS a, max(CASE WHEN w = 'that' THEN p END) OVER o AS b FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
c AS (SELECT *, least(a, b) AS s, lag(least(a, b)) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM l WHERE a IS NOT NULL AND b IS NOT NULL), r AS (SELECT doc_id, sum(0.1::DOUBLE / (1 + p - s - 1)) AS rank FROM c WHERE before IS NULL OR s > before GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(rank, 0.0), 9) AS rank FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id""")
def cover_density(spark, d):
    rows = table(spark, d, "documents").withColumn("w", text.tokens(F.coalesce("text", F.lit(""))))
    return rows.select("doc_id", F.round(text.cover_density(F.col("w"), ["the", "that"]), 9).alias("rank"))


@query(f"SELECT doc_id, len({_WORDS}) AS n, md5(array_to_string({_WORDS}, ' ')) AS words_md5 FROM documents")
def word_tokens(spark, d):
    rows = table(spark, d, "documents").withColumn("w", text.tokens(F.coalesce("text", F.lit(""))))
    return rows.select("doc_id", F.size("w").cast("bigint").alias("n"), F.md5(F.array_join("w", " ")).alias("words_md5"))


_STRIP = _sql_replaced("html", [(r"(?i)<br\s*/?>", "\n"), ("(?i)<p>", "\n"), ("(?i)</p>", ""), ("<[^>]+>", ""), *[text.ENTITIES[i] for i in (1, 2, 3, 4, 5, 0)], ("\\n{3,}", "\n\n")])


@query(f"SELECT page_id, md5(regexp_replace({_STRIP}, '^{_WS}+|{_WS}+$', '', 'g')) AS text_md5 FROM pages")
def html_stripped(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.html_stripped(F.col("html"))).alias("text_md5"))


@query(f"SELECT page_id, length(regexp_replace({_HTML}, '^{_WS}+|{_WS}+$', '', 'g')) AS chars FROM pages WHERE length(regexp_replace({_HTML}, '^{_WS}+|{_WS}+$', '', 'g')) >= 20")
def page_posts(spark, d):
    body = text.html_to_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.char_length(body).cast("bigint").alias("chars")).where("chars >= 20")


@query("SELECT doc_id, len(regexp_extract_all(c, '[.!?]+')) AS sentences, CASE WHEN regexp_matches(c, '(?i)\\bevergreen\\b') THEN 1 ELSE 0 END AS evergreen FROM (SELECT doc_id, coalesce(text, '') AS c FROM documents)")
def sentence_counts(spark, d):
    c = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.regexp_count(c, F.lit("[.!?]+")).cast("bigint").alias("sentences"), c.rlike(r"(?i)\bevergreen\b").cast("int").alias("evergreen"))


@query("SELECT c_custkey AS conv_id, i AS rank, CASE WHEN i <= 5 THEN 'We decided to use plan number ' || i || ' for this.' END AS line FROM customer, (SELECT unnest(range(1, 6)) AS i)")
def findings_of_samples(spark, d):
    """Seven decisions in each conversation, of which the first five count; a repeated line counts once."""
    n = F.sequence(F.lit(1), F.lit(7))
    said = F.array_join(F.transform(n, lambda i: F.concat(F.lit("We decided to use plan number "), i, F.lit(" for this. Fine. We decided to use plan number "), i, F.lit(" for this."))), "\n")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), said.alias("text"))
    return curation.findings(rows).select("conv_id", F.col("rank").cast("bigint").alias("rank"), "line")


@query("SELECT o_custkey AS key, o_orderstatus AS status, min(o_orderkey) AS first FROM orders GROUP BY ALL")
def distinct_first(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status")).agg(F.min("o_orderkey").alias("first"))


@query("""WITH n AS (SELECT conv_id, turn::VARCHAR AS node_id, turn, false AS dead FROM conversations), m AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) SELECT n.conv_id, node_id, turn AS position FROM n JOIN m USING (conv_id)""")
def chat_paths(spark, d):
    """Every chat is a line of turns with a dead branch at every third one."""
    from .stored import checkpointing

    checkpointing(spark)
    n = F.col("turn")
    rows = table(spark, d, "conversations").select("conv_id", n.cast("string").alias("node_id"), F.when(n > 0, (n - 1).cast("string")).alias("parent"))
    last = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    dead = table(spark, d, "conversations").join(last.withColumnRenamed("turn", "last"), "conv_id").where("turn % 3 = 0 AND turn < last").select("conv_id", F.concat(F.lit("0x"), n).alias("node_id"), n.cast("string").alias("parent"))
    rows = rows.union(dead).join(last.select("conv_id", F.col("turn").cast("string").alias("leaf")), "conv_id").withColumn("is_current", F.col("node_id") == F.col("leaf")).drop("leaf")
    return importers.canonical_path(rows).select("conv_id", "node_id", "position")


@query("""WITH k AS (SELECT event_id, user_id, ts, 'event number ' || event_id || ' of type ' || event_type AS t FROM events WHERE event_id % 10 > 0), b AS (SELECT *, (row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) - 1) // 20 AS batch FROM k)
SELECT ts::DATE::VARCHAR AS k, batch, md5(string_agg(t, chr(10) || chr(10) ORDER BY ts, event_id)) AS content_md5, count(*) AS n FROM b GROUP BY ALL""")
def post_batches(spark, d):
    n = F.col("event_id")
    rows = table(spark, d, "events").select(n.alias("id"), F.col("ts").alias("created_at"), F.when(n % 20 == 0, "RT @x a shared post that is long enough").when(n % 10 == 0, "short").otherwise(F.concat(F.lit("event number "), n, F.lit(" of type "), "event_type")).alias("full_text"))
    return importers.tweets(rows, least=10).select("k", F.col("batch").cast("bigint").alias("batch"), F.md5("content").alias("content_md5"), "n")


@query("""WITH m AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id::VARCHAR) AS r, event_type || ': ' || event_id AS line FROM events), k AS (SELECT * FROM m WHERE r <= 10)
SELECT user_id AS conversation_id, md5(string_agg(line, chr(10) ORDER BY r)) AS content_md5, count(*) AS messages FROM k GROUP BY user_id HAVING count(*) >= 3""")
def message_threads(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("conversation_id"), F.col("event_type").alias("sender"), "ts", F.col("event_id").cast("string").alias("text"))
    return importers.direct_messages(rows, 3, 10).select("conversation_id", F.md5("content").alias("content_md5"), "messages")


@query("""WITH b AS (SELECT *, (row_number() OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY ts, event_id) - 1) // 50 AS batch FROM events) SELECT strftime(ts, '%Y-%m') AS k, batch, md5(string_agg(event_type, chr(10) ORDER BY ts, event_id)) AS content_md5, count(*) AS n FROM b GROUP BY ALL""")
def comment_batches(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("text"))
    return importers.comments(rows).select("k", F.col("batch").cast("bigint").alias("batch"), F.md5("content").alias("content_md5"), "n")


@query("""SELECT CASE WHEN event_id % 2 = 0 THEN 'Maps' ELSE 'Search' END AS category, substr(ts::VARCHAR, 1, 10) AS day, count(*) AS n FROM events WHERE event_id % 4 > 0 GROUP BY ALL""")
def activity_days(spark, d):
    n = F.col("event_id")
    rows = table(spark, d, "events").select(F.when(n % 2 == 0, "Maps").otherwise("Search").alias("category"), F.when(n % 4 == 0, "Visited some place").otherwise("Searched for something").alias("title"), F.col("ts").cast("string").alias("time"))
    return importers.activity_days(rows).select("category", "day", "n")


@query("SELECT user_id AS conv_id, (row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 5 > 0 THEN ts END NULLS FIRST, event_id::VARCHAR) - 1) AS turn, event_id::VARCHAR AS text FROM events")
def chat_turns(spark, d):
    n = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.lit("Human").alias("sender"), n.cast("string").alias("message"), F.lit(None).cast("string").alias("date_text"), F.when(n % 5 > 0, F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).alias("millis"))
    return importers.chat_rows(rows).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "text")


@query("SELECT event_id FROM events WHERE event_id % 3 > 0")
def kept_memories(spark, d):
    n = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.when(n % 3 == 0, "TRUE").otherwise("false").alias("IS_DELETED"), F.when(n % 6 == 0, "yes").alias("IS_FORGOTTEN"))
    return importers.kept_memories(rows, ["IS_DELETED", "IS_FORGOTTEN"]).select("event_id")


@query(f"SELECT e.vec_id, round(sqrt({_DOT('e.embedding', 'e.embedding')}), 6) AS norm FROM embeddings e")
def vector_lengths(spark, d):
    from ..functions import vectors

    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


@query(f"WITH {NOTES_SQL} SELECT sha256(regexp_replace(lower(trim('Note  ' || id)), '\\s+', ' ', 'g')) AS hash, id FROM notes")
def memory_hashes(spark, d):
    return views.notes(spark, d).select(text.fingerprint(F.concat(F.lit("Note  "), F.col("id"))).alias("hash"), "id")


# ---- files written from the tables and read again -------------------------------------------------


@query(f"""SELECT conv_id::VARCHAR AS conv_id, turn AS position, role, length(regexp_replace(coalesce(text, ''), '^{_WS}+|{_WS}+$', '', 'g')) AS n_chars FROM conversations""")
def chat_array(spark, d):
    """All conversations as one export file, one JSON array, which many tasks read: the turns in order."""
    from .stored import checkpointing, scratch

    checkpointing(spark)
    n = F.col("turn")
    message = F.struct(F.struct("role").alias("author"), F.lit(0.0).alias("create_time"), F.struct(F.lit("text").alias("content_type"), F.array(F.coalesce("text", F.lit(""))).alias("parts")).alias("content"))
    node = F.struct(n.cast("string").alias("id"), F.when(n > 0, (n - 1).cast("string")).alias("parent"), message.alias("message"))
    chats = table(spark, d, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(n.cast("string"), node))).alias("mapping"), F.max("turn").cast("string").alias("current_node"))
    one = F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.lit('odd "title" ]},[{ \\').alias("title"), "current_node", "mapping"))
    first = chats.agg(F.min("conv_id")).first()[0]
    lines = chats.select(F.lit(1).alias("k"), "conv_id", F.concat(F.when(F.col("conv_id") == first, "[").otherwise(","), one).alias("value"))
    lines = lines.union(spark.createDataFrame([(2, None, "]")], lines.schema))
    path = scratch(spark, "export")
    lines.orderBy("k", "conv_id").coalesce(1).select("value").write.text(path)  # an export is one file
    fs = spark._jvm.org.apache.hadoop.fs
    folder = fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for part in store.globStatus(fs.Path(f"{path}/part-*")):
        store.rename(part.getPath(), fs.Path(f"{path}/conversations.json"))
    nodes = importers.chat_nodes(importers.chat_export(spark, path, 64 << 10))
    return importers.canonical_path(nodes).select("conv_id", "position", "role", F.char_length("text").cast("bigint").alias("n_chars"))


@query("""SELECT doc_id AS id, source, 2 AS n_list, CASE WHEN doc_id % 2 = 0 THEN replace(replace(left(text, 40), chr(92), '/'), '"', '`') END AS said, n_chars + 3 AS total
FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL AND length(text) > 0""")
def repaired_rows(spark, d):
    """Rows written as a model writes JSON nearly right (fences, single quotes, commas too many and too
    few, raw line ends, no end), repaired and read."""
    rows = table(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL AND length(text) > 0")
    said = F.replace(F.replace(F.substring("text", 1, 40), F.lit("\\"), F.lit("/")), F.lit('"'), F.lit("`"))
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"'), said, F.lit('"'))).otherwise(F.lit("None"))
    broken = F.concat(F.lit("```json\n{'id': "), "doc_id", F.lit(', "source": "'), "source", F.lit('",, "list": ["'), "lang", F.lit('"\n "x",],\n"said": '), said, F.lit("\n'sums': ["), "n_chars", F.lit(", 1,\n2"))
    e = F.from_json(json_repair.repaired(broken), "id bigint, source string, list array<string>, said string, sums array<bigint>")
    got = rows.select(e.alias("e"))
    return got.select("e.id", "e.source", F.size("e.list").alias("n_list"), "e.said", F.aggregate("e.sums", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))
