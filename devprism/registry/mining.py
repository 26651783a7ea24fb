"""Queries over the mining steps. Records and migrated texts are derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from devprism.functions import migration, records
from devprism.operators import mining as ops
from devprism.registry.core import query
from devprism.registry.tables import sql, table
from devprism.runtime import shared_folder
from devprism.sources import files

PROJECTS = list(records.REPOSITORIES) + ["Unknown"]
NAMES = ", ".join(f"'{p}'" for p in PROJECTS)
ISSUES_URL = "https://api.github.com/repos/apache/lucene/issues/"
COMMENT_LINK = (
    "https://issues.apache.org/jira/browse/X-{}?focusedCommentId=1&page="
    "com.atlassian.jira.plugin.system.issuetabpanels:comment-tabpanel#comment-1))"
)

# --- projects, commits, calls ----------------------------------------------------------------


def project(key: str):
    return F.expr(f"element_at(array({NAMES}), cast({key} % {len(PROJECTS)} as int) + 1)")


def sql_project(key: str) -> str:
    return f"[{NAMES}][CAST({key} % {len(PROJECTS)} AS INTEGER) + 1]"


def commit_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        project("o_orderkey").alias("project"),
        F.col("o_orderkey").cast("string").alias("transactionid"),
        F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("commit"),
    )


def bug_metrics(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        project("l_orderkey").alias("project"),
        F.col("l_orderkey").cast("string").alias("transactionid"),
        F.col("l_linenumber").alias("ns"),
        F.expr("cast(l_linestatus = 'F' as int)").alias("bug"),
    )


def bug_eb_metrics(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        project("o_orderkey").alias("project"),
        F.col("o_orderkey").cast("string").alias("transactionid"),
        F.lit(0).alias("ns"),
        F.expr("cast(o_orderstatus = 'F' as int)").alias("bug"),
    )


REPO_CASE = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in records.REPOSITORIES.items()) + " END"
IDS = f"""SELECT {sql_project('o_orderkey')} AS project, {sql_project('o_orderkey')} || '_' || o_orderkey AS transactionid,
    md5(CAST(o_orderkey AS VARCHAR)) AS commit FROM orders"""
CALLS = f"""SELECT transactionid, {REPO_CASE.format('project')} AS repo,
    '{records.API}' || {REPO_CASE.format('project')} || '/commits/' || commit AS call FROM ids"""
LABELLED = f"""SELECT {sql_project('l_orderkey')} || '_' || l_orderkey AS transactionid, l_linenumber AS ns,
    CAST(l_linestatus = 'F' AS INTEGER) AS bug, CAST(o_orderstatus = 'F' AS INTEGER) AS "bug_EB"
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query("commit_calls", "P1 P2 P3", sql(CALLS, ids=IDS))
def commit_calls(spark, sf_dir):
    ids = ops.commit_call(ops.map_repo(ops.qualify_id(commit_ids(spark, sf_dir))))
    return ops.project_columns(ids, ["transactionid", "repo", "call"])


ISSUE_NAME = """CASE o_orderkey % 4 WHEN 0 THEN 'LUCENE-' || o_orderkey WHEN 1 THEN '' || o_orderkey
    WHEN 2 THEN 'A-' || o_orderkey || '-2' END"""


def issue_names(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", project("o_custkey").alias("project"), F.expr(ISSUE_NAME).alias("issue_names")
    )


@query(
    "issue_calls", "P2 P4",
    sql(
        f"""SELECT o_orderkey, issue_names, '{records.API}' || {REPO_CASE.format('project')} || '/issues/' ||
        CASE WHEN contains(issue_names, '-') THEN string_split(issue_names, '-')[2] ELSE issue_names END AS issue_call FROM n""",
        n=f"SELECT o_orderkey, {sql_project('o_custkey')} AS project, {ISSUE_NAME} AS issue_names FROM orders",
    ),
)
def issue_calls(spark, sf_dir):
    named = ops.issue_call(ops.map_repo(issue_names(spark, sf_dir)))
    return named.select("o_orderkey", "issue_names", "issue_call")


def labelled(spark, sf_dir):
    bug = ops.qualify_id(bug_metrics(spark, sf_dir)).drop("project")
    bug_eb = ops.rename_label(ops.qualify_id(bug_eb_metrics(spark, sf_dir))).drop("project")
    return ops.join_labels(bug, bug_eb)


@query("labelled_commits", "J1 P5 U3", LABELLED)
def labelled_commits(spark, sf_dir):
    return labelled(spark, sf_dir)


@query(
    "raw_commits", "J2 U1 P13",
    sql(
        f"SELECT DISTINCT transactionid, repo, call, ns, bug, \"bug_EB\" FROM ({CALLS}) JOIN ({LABELLED}) USING (transactionid)",
        ids=IDS,
    ),
)
def raw_commits(spark, sf_dir):
    return ops.join_commits(commit_calls(spark, sf_dir), labelled(spark, sf_dir))


@query(
    "all_projects", "S4 P6",
    f"""SELECT {sql_project('l_orderkey')} AS project, CAST(l_orderkey AS VARCHAR) AS transactionid,
        CAST(l_linestatus = 'F' AS INTEGER) AS bug, CAST(NULL AS INTEGER) AS "bug_EB" FROM lineitem
        UNION ALL SELECT {sql_project('o_orderkey')}, CAST(o_orderkey AS VARCHAR), NULL,
        CAST(o_orderstatus = 'F' AS INTEGER) FROM orders""",
)
def all_projects(spark, sf_dir):
    numbered = bug_metrics(spark, sf_dir).withColumnRenamed("ns", "Unnamed: 0")
    other = ops.rename_label(bug_eb_metrics(spark, sf_dir)).withColumnRenamed("ns", "Unnamed: 0")
    return ops.drop_index_columns(ops.concat_projects([numbered, other]))


@query(
    "delimited_round_trip", "S2 S3",
    "SELECT o_orderkey, o_orderpriority || chr(10) || '\"' || o_orderstatus || '\", x' AS note, o_totalprice FROM orders",
)
def delimited_round_trip(spark, sf_dir):
    """Write the orders as a quoted multi-line file in the shared folder and read it back typed."""
    note = F.concat("o_orderpriority", F.lit('\n"'), "o_orderstatus", F.lit('", x'))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", note.alias("note"), "o_totalprice")
    path = f"{shared_folder(spark)}/devprism/orders-{uuid.uuid4().hex}"
    orders.write.mode("overwrite").options(header=True, sep=";", escape='"').csv(path)
    return files.read_scsv(spark, path, {"o_orderkey": "bigint", "o_totalprice": "double"})


# --- landed responses ------------------------------------------------------------------------


def event_responses(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit(ISSUES_URL), F.col("event_id").cast("string")).alias("call"),
        F.expr("case when event_type = 'error' then 404 else 200 end").alias("status"),
        F.expr(
            "case event_type when 'click' then concat('{\"author\":{\"login\":\"dev', user_id, '\"}}') "
            "when 'view' then '{\"author\":null}' else props end"
        ).alias("body"),
    )


def called_orders(spark, sf_dir):
    call = F.expr(f"case when o_orderstatus <> 'P' then concat('{ISSUES_URL}', o_orderkey) end")
    return table(spark, sf_dir, "orders").select("o_orderkey", call.alias("call"))


def answered(spark, sf_dir):
    return ops.join_responses(called_orders(spark, sf_dir), event_responses(spark, sf_dir), "call")


ANSWERED = """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL
    WHEN event_id IS NULL OR event_type = 'error' THEN 'NOT FOUND'
    WHEN event_type = 'click' THEN '{"author":{"login":"dev' || user_id || '"}}'
    WHEN event_type = 'view' THEN '{"author":null}' ELSE props END AS details
    FROM orders LEFT JOIN events ON event_id = o_orderkey"""


@query("answered_calls", "S5", ANSWERED)
def answered_calls(spark, sf_dir):
    return answered(spark, sf_dir).select("o_orderkey", "details")


@query("found_calls", "F1", f"SELECT * FROM ({ANSWERED}) WHERE details IS DISTINCT FROM 'NOT FOUND'")
def found_calls(spark, sf_dir):
    return ops.drop_not_found(answered_calls(spark, sf_dir))


AUTHOR = """SELECT o_orderkey, CASE WHEN details LIKE '{"author":{%' THEN json_extract_string(details, '$.author.login')
    ELSE 'N' END AS author FROM a"""


@query("commit_authors", "P12", sql(AUTHOR, a=ANSWERED))
def commit_authors(spark, sf_dir):
    return ops.commit_author(answered_calls(spark, sf_dir)).select("o_orderkey", "author")


@query("named_commit_authors", "F3", sql(f"SELECT * FROM ({AUTHOR}) WHERE author <> 'N'", a=ANSWERED))
def named_commit_authors(spark, sf_dir):
    named = ops.commit_author(answered_calls(spark, sf_dir), drop_unknown=True)
    return named.select("o_orderkey", "author")


# --- issues and comments from the conversations ----------------------------------------------

DAY = "'2024-01-' || lpad(CAST({} % 28 + 1 AS VARCHAR), 2, '0') || 'T10:00:00Z'"
SPARK_DAY = "concat('2024-01-', lpad(cast({} % 28 + 1 as string), 2, '0'), 'T10:00:00Z')"


def issue_records(spark, sf_dir):
    """One issue per conversation: its first turn, and how many turns follow it."""
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        (F.count("*") - 1).cast("int").alias("n"),
        F.min_by("text", "turn").alias("text"),
        F.min_by("role", "turn").alias("role"),
    )
    url = f"concat('{ISSUES_URL}', conv_id)"
    body = F.expr(
        f"""to_json(named_struct('comments', n, 'title', concat('Talk ', conv_id), 'body', text,
        'user', named_struct('login', role), 'labels', array(named_struct('name', role), named_struct('name', 'talk')),
        'author_association', 'MEMBER', 'created_at', {SPARK_DAY.format('conv_id')},
        'updated_at', {SPARK_DAY.format('(conv_id + 1)')},
        'closed_at', case when n > 1 then {SPARK_DAY.format('(conv_id + 2)')} end,
        'comments_url', concat({url}, '/comments')))"""
    )
    pull = F.expr(
        "case conv_id % 3 when 0 then '{\"pull_request\":null,' when 1 then '{\"pull_request\":{\"url\":\"u\"},' else '{' end"
    )
    return talks.select(
        "conv_id", F.expr(url).alias("issue_call"), F.concat(pull, F.substr(body, F.lit(2))).alias("issue")
    )


def comment_pages(spark, sf_dir):
    """Pages of at most 30 comments, as an API would answer them; no page grows with its issue."""
    turns = table(spark, sf_dir, "conversations").filter("turn > 0")
    one = F.expr(
        f"""named_struct('turn', turn, 'issue_url', concat('{ISSUES_URL}', conv_id), 'id', conv_id * 1000 + turn,
        'created_at', {SPARK_DAY.format('turn')}, 'updated_at', {SPARK_DAY.format('(turn + 1)')},
        'author_association', 'NONE', 'body', text, 'user', named_struct('login', role),
        'reactions', named_struct('total_count', cast(turn as int), '+1', 1, '-1', 0, 'laugh', 0, 'hooray', 0,
        'confused', 0, 'heart', 2, 'rocket', 0, 'eyes', cast(turn % 2 as int)))"""
    )
    pages = turns.groupBy("conv_id", F.expr("turn div 30").alias("page")).agg(
        F.to_json(F.array_sort(F.collect_list(one))).alias("comments")
    )
    return pages


FIRST = """SELECT conv_id, CAST(count(*) - 1 AS INTEGER) AS n, arg_min(text, turn) AS text, arg_min(role, turn) AS role
    FROM conversations GROUP BY conv_id"""
EPOCH = "CAST(epoch(CAST(rtrim({}, 'Z') AS TIMESTAMP)) AS BIGINT)"


@query(
    "issue_fields", "P7 P8 P9",
    sql(
        f"""SELECT conv_id, n AS num_comments, 'Talk ' || conv_id AS issue_title, text AS issue_body, role AS issue_user,
        role || '|talk' AS issue_labels, 'MEMBER' AS issue_author_association,
        {EPOCH.format(DAY.format('conv_id'))} AS issue_created_at, {EPOCH.format(DAY.format('(conv_id + 1)'))} AS issue_updated_at,
        CASE WHEN n > 1 THEN {EPOCH.format(DAY.format('(conv_id + 2)'))} END AS issue_closed_at,
        conv_id % 3 < 2 AS is_pull_request,
        CASE WHEN n > 0 THEN '{ISSUES_URL}' || conv_id || '/comments' END AS comments_call FROM f""",
        f=FIRST,
    ),
)
def issue_fields(spark, sf_dir):
    fields = ops.issue_fields(issue_records(spark, sf_dir))
    times = {c: F.unix_timestamp(c) for c in ["issue_created_at", "issue_updated_at", "issue_closed_at"]}
    return fields.withColumns({**times, "issue_labels": F.array_join("issue_labels", "|")}).drop("issue", "issue_call")


@query(
    "comment_arrays", "P10",
    f"""SELECT conv_id, turn // 30 AS page, string_agg(CAST(conv_id * 1000 + turn AS VARCHAR), '|' ORDER BY turn) AS ids,
        string_agg(text, '|' ORDER BY turn) AS bodies, string_agg(role, '|' ORDER BY turn) AS users,
        string_agg(CAST({EPOCH.format(DAY.format('(turn + 1)'))} AS VARCHAR), '|' ORDER BY turn) AS dates
        FROM conversations WHERE turn > 0 GROUP BY ALL""",
)
def comment_arrays(spark, sf_dir):
    arrays = ops.comment_arrays(comment_pages(spark, sf_dir))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), "|")
    dates = F.array_join(F.transform("comments_dates", lambda t: F.unix_timestamp(t).cast("string")), "|")
    return arrays.select(
        "conv_id", "page", join("comments_ids").alias("ids"), join("comments_bodies").alias("bodies"),
        join("comments_users").alias("users"), dates.alias("dates"),
    )


COMMENTS = f"""SELECT '{ISSUES_URL}' || conv_id AS issue_url, conv_id * 1000 + turn AS comment_id, text AS comment_body,
    role AS user_login, CAST(turn AS INTEGER) AS reactions_total_count, 1 AS reactions_plus1, 2 AS reactions_heart,
    CAST(turn % 2 AS INTEGER) AS reactions_eyes FROM conversations WHERE turn > 0"""
COMMENT_KEEP = [
    "issue_url", "comment_id", "comment_body", "user_login", "reactions_total_count", "reactions_plus1",
    "reactions_heart", "reactions_eyes",
]


@query("comments", "P11", COMMENTS)
def comments(spark, sf_dir):
    return ops.explode_comments(comment_pages(spark, sf_dir)).select(*COMMENT_KEEP)


def known_issues(spark, sf_dir):
    """Issues with an answer; those opened by the system account have none."""
    fields = ops.issue_fields(issue_records(spark, sf_dir))
    return fields.filter("issue_user <> 'system'").select("issue_call", "issue_title", "issue_user", "is_pull_request")


ISSUE_COMMENTS = sql(
    f"""SELECT issue_title, issue_user, is_pull_request, comment_id, user_login, comment_body, reactions_plus1
    FROM (SELECT '{ISSUES_URL}' || conv_id AS issue_call, 'Talk ' || conv_id AS issue_title, role AS issue_user,
          conv_id % 3 < 2 AS is_pull_request FROM f WHERE role <> 'system')
    FULL OUTER JOIN ({COMMENTS}) ON issue_call = issue_url""",
    f=FIRST,
)


@query("issue_comments", "J3 P13", ISSUE_COMMENTS)
def issue_comments(spark, sf_dir):
    both = ops.join_issue_comments(known_issues(spark, sf_dir), comments(spark, sf_dir))
    return both.select(
        "issue_title", "issue_user", "is_pull_request", "comment_id", "user_login", "comment_body", "reactions_plus1"
    )


@query(
    "human_comments", "F2",
    f"SELECT * FROM ({ISSUE_COMMENTS}) WHERE (user_login IS NULL OR user_login NOT IN ('assistant', 'Apache-HBase'))",
)
def human_comments(spark, sf_dir):
    return ops.drop_accounts(issue_comments(spark, sf_dir), "user_login", ["assistant", "Apache-HBase"])


@query("comment_presence", "F5", f"SELECT comment_id, user_login FROM ({ISSUE_COMMENTS}) WHERE comment_body IS NOT NULL AND reactions_plus1 IS NOT NULL")
def comment_presence(spark, sf_dir):
    from devprism.operators import sentiment

    real = sentiment.has_reactions(sentiment.has_text(issue_comments(spark, sf_dir)))
    return real.select("comment_id", "user_login")


@query(
    "document_text", "P14",
    """SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN source END, 'nan') || ' ' ||
        coalesce(CASE WHEN quality IS NOT NULL THEN text END, 'nan') AS raw_text
        FROM documents LEFT JOIN labels USING (doc_id)""",
)
def document_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    parts = docs.select(
        "doc_id",
        F.expr("case when lang = 'en' then source end").alias("issue_title"),
        F.expr("case when quality is not null then text end").alias("issue_body"),
    )
    return ops.document_text(parts).select("doc_id", "raw_text")


@query(
    "attached_labels", "J4",
    "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
)
def attached_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return ops.attach_columns(docs, table(spark, sf_dir, "labels"), "doc_id")


# --- migrated text ---------------------------------------------------------------------------

SEEN = " see https://issues.apache.org/jira/browse/ABC-12 and https://apache.github.io/x-jira-archive/attachments/AB-1"
LINK_HEAD, LINK_TAIL = COMMENT_LINK.split("{}")


def migrated(spark, sf_dir):
    """Documents as texts of the import bot: two in three with a marker, some logins with a dash."""
    docs = table(spark, sf_dir, "documents")
    login = F.expr("case when doc_id % 5 = 1 then concat('s-', source) else source end")
    number = F.col("doc_id").cast("string")
    comment = F.concat(
        F.lit("by (@"), login, F.lit(") " + migration.COMMENT_MARKER + "(" + LINK_HEAD), number,
        F.lit(LINK_TAIL + "\n\n"), F.col("text"), F.lit(SEEN),
    )
    issue = F.concat("text", F.lit(migration.ISSUE_MARKER + " [X] by (@"), login, F.lit("), resolved"))
    marked, bot = F.expr("doc_id % 3 <> 0"), F.expr("doc_id % 4 <> 3")
    user = F.when(bot, F.lit(migration.IMPORT_BOT)).otherwise(F.col("source"))
    return docs.select(
        "doc_id",
        user.alias("issue_user"),
        user.alias("user_login"),
        F.when(marked, issue).otherwise(F.col("text")).alias("issue_body"),
        F.when(marked, comment).otherwise(F.col("text")).alias("comment_body"),
    )


LOGIN = "CASE WHEN doc_id % 5 = 1 THEN 's-' || source ELSE source END"
MIGRATED = f"""SELECT doc_id, text, source, doc_id % 3 <> 0 AS marked, doc_id % 4 <> 3 AS bot, doc_id % 5 = 1 AS dashed,
    CASE WHEN doc_id % 4 <> 3 THEN 'asfimport' ELSE source END AS user_login,
    CASE WHEN doc_id % 3 <> 0 THEN 'by (@' || {LOGIN} || ') {migration.COMMENT_MARKER}({LINK_HEAD}' || doc_id || '{LINK_TAIL}'
        || chr(10) || chr(10) || text || '{SEEN}' ELSE text END AS comment_body,
    CASE WHEN doc_id % 3 <> 0 THEN text || repeat(chr(10), 4) || '---' || chr(10) || 'Migrated from [X] by (@' || {LOGIN}
        || '), resolved' ELSE text END AS issue_body FROM documents"""
LINKS = ["https://apache.github.io/", "https://issues.apache.org/jira/browse/"]


@query(
    "migration_markers", "T1 T2",
    sql(
        """SELECT doc_id, string_split(comment_body, '([migrated from JIRA]')[1] AS before,
        string_split(comment_body, '([migrated from JIRA]')[2] AS after,
        nullif(replace(replace(replace(regexp_extract(string_split(comment_body, '([migrated from JIRA]')[1],
            '\\(@[A-Za-z0-9]*\\)'), '(', ''), ')', ''), '@', ''), '') AS login_before,
        CASE WHEN len(string_split(comment_body, '([migrated from JIRA]')) < 2 THEN 'asfimport' ELSE
        nullif(replace(replace(replace(regexp_extract(string_split(comment_body, '([migrated from JIRA]')[2],
            '\\(@[A-Za-z0-9]*\\)'), '(', ''), ')', ''), '@', ''), '') END AS login_after FROM m""",
        m=MIGRATED,
    ),
)
def migration_markers(spark, sf_dir):
    body = F.col("comment_body")
    before = migration.before_marker(body, migration.COMMENT_MARKER)
    after = migration.after_marker(body, migration.COMMENT_MARKER)
    return migrated(spark, sf_dir).select(
        "doc_id", before.alias("before"), after.alias("after"),
        migration.extract_login(before).alias("login_before"), migration.extract_login(after).alias("login_after"),
    )


def sql_links(text: str) -> str:
    for category, pattern in migration.LINK_PATTERNS.items():
        text = f"regexp_replace({text}, '{pattern}', '[{category}_LINK]', 'g')"
    return text


@query(
    "replaced_links", "T3 T4",
    sql(
        f"""SELECT doc_id, linked, string_split(linked, e'([JIRA_ISSUE_COMMENT_LINK]\\n\\n')[1] ||
        coalesce(string_split(linked, e'([JIRA_ISSUE_COMMENT_LINK]\\n\\n')[2], '') AS stripped
        FROM (SELECT doc_id, {sql_links('comment_body')} AS linked FROM m)""",
        m=MIGRATED,
    ),
)
def replaced_links(spark, sf_dir):
    linked = migrated(spark, sf_dir).select("doc_id", migration.replace_links(F.col("comment_body")).alias("linked"))
    return linked.withColumn("stripped", migration.strip_migration_link(F.col("linked")))


@query(
    "reattributed_issues", "T5 U2",
    sql(
        """SELECT doc_id, CASE WHEN NOT bot THEN source WHEN NOT marked THEN 'asfimport' WHEN dashed THEN NULL ELSE source END AS issue_user,
        CASE WHEN bot THEN text ELSE issue_body END AS issue_body FROM m""",
        m=MIGRATED,
    ),
)
def reattributed_issues(spark, sf_dir):
    return ops.reattribute_issues(migrated(spark, sf_dir)).select("doc_id", "issue_user", "issue_body")


@query(
    "reattributed_comments", "T6 U2",
    sql(
        f"""SELECT doc_id, CASE WHEN NOT bot THEN source WHEN NOT marked OR dashed THEN 'asfimport' ELSE source END AS user_login,
        CASE WHEN NOT bot THEN comment_body WHEN marked THEN {sql_links(f"text || '{SEEN}'")} ELSE {sql_links('text')} END AS comment_body
        FROM m""",
        m=MIGRATED,
    ),
)
def reattributed_comments(spark, sf_dir):
    return ops.reattribute_comments(migrated(spark, sf_dir)).select("doc_id", "user_login", "comment_body")
