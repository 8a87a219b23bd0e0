"""Queries of fitted models: each is fitted to a rule that SQL can state, on a part of the rows, and applied to the others.

That shows that features, fitting, saving and prediction fit together. The rules are about which events a session holds.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.config import for_log_type
from timberline.models import detectors, estimators, incremental
from timberline.operators import matrix, sequences, vocabulary
from timberline.plans.shared import materialise, shared_dir
from timberline.plans.tables import table
from timberline.queries import _BAYES, _MEMBERS, _REC, _SEQ, SPAN, STEP, WIDTH, _sequences, query, records, timed

#: Words of templates; whether a session holds an event with one of them is a feature.
MARKS = ["clock drift", "queue depth", "noise level", "worker pool", "lost its lock", "lease", "stale frames", "greeted"]
#: The first mark that a session holds is its class, none is the last; a session is abnormal if it holds the first.
_HOLDS = f"""{_REC}, holds AS (SELECT session_id, {", ".join(f"max((eventtemplate LIKE '%{m}%')::INT) AS m{i}" for i, m in enumerate(MARKS))} FROM rec WHERE session_id IS NOT NULL AND eventid IS NOT NULL GROUP BY session_id),
ruled AS (SELECT session_id, m0 AS label, CASE WHEN m0 = 1 THEN 0 WHEN m1 = 1 THEN 1 ELSE 2 END AS class, md5(session_id::VARCHAR)[1:1] IN ('0', '1', '2', '3', '4') AS held FROM holds)"""


def marked_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """session_id, label, class, held (kept out of fitting), features: marks, those of the rule twice."""
    r = records(spark, folder).where("session_id IS NOT NULL AND eventid IS NOT NULL")
    x = r.groupBy("session_id").agg(*[F.coalesce(F.max(F.col("eventtemplate").like(f"%{m}%").cast("int")), F.lit(0)).alias(f"m{i}") for i, m in enumerate(MARKS)])
    kind = F.when(F.col("m0") == 1, 0).when(F.col("m1") == 1, 1).otherwise(2)
    x = x.withColumns({"label": F.col("m0"), "class": kind, "held": F.substring(F.md5(F.col("session_id").cast("string")), 1, 1) < "5"})
    # the long form: the marks, those of the rule again, and what tells the classes apart
    own = [F.col("m0"), F.col("m0"), ((F.col("m0") == 0) & (F.col("m1") == 1)).cast("int"), ((F.col("m0") == 0) & (F.col("m1") == 0)).cast("int")]
    values = F.array(*[F.col(f"m{i}") for i in range(len(MARKS))], *own)
    cells = x.select("session_id", F.posexplode(values).alias("idx", "n")).where("n > 0")
    return matrix.vectors(cells, x.select("session_id", "label", "class", "held"), ["session_id"], len(MARKS) + len(own))


def _predicted(name: str, label: str):
    def f(spark: SparkSession, folder: str) -> DataFrame:
        x = marked_sessions(spark, folder).withColumn("truth", F.col(label)).drop("label").withColumnRenamed("truth", "label")
        fitted = x.where("NOT held")
        model = estimators.estimator(name, fitted.count()).fit(fitted)
        return model.transform(x.where("held")).select("session_id", F.col("prediction").cast("int").alias("predicted"))

    f.__name__ = f"q_fitted_{name}"
    return f


for _name, _label in (("tree", "label"), ("forest", "label"), ("logistic", "label"), ("vectors", "label"), ("forest_multi", "class"), ("logistic_multi", "class"), ("vectors_multi", "class")):
    query(f"WITH {_HOLDS} SELECT session_id, {_label} AS predicted FROM ruled WHERE held")(_predicted(_name, _label))


def _learnt(name: str):
    def f(spark: SparkSession, folder: str) -> DataFrame:
        """Learnt in two batches, saved and loaded between them."""
        x = marked_sessions(spark, folder)
        fitted, key = x.where("NOT held"), ["session_id"]
        model = incremental.learner(name, key, len(MARKS) + 4).partial_fit(fitted.where("session_id % 2 = 0"))
        out = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
        incremental.save(model, out, spark)
        model = incremental.load(name, key, out, spark).partial_fit(fitted.where("session_id % 2 = 1"))
        return model.transform(x.where("held")).select("session_id", F.col("prediction").cast("int").alias("predicted"))

    f.__name__ = f"q_learnt_{name}"
    return f


for _name in incremental.LOSSES:
    query(f"WITH {_HOLDS} SELECT session_id, label AS predicted FROM ruled WHERE held")(_learnt(_name))


@query(f"WITH {_BAYES} SELECT label, eventid, n, s, ss FROM st")
def q_gnb_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of naive Bayes added up from two batches are those of the whole."""
    from timberline.models import bayes
    from timberline.queries import _session_cells

    cells, instances = (materialise(t) for t in _session_cells(spark, folder))
    halves = []
    for k in (0, 1):
        part = instances.where(F.pmod("session_id", F.lit(2)) == k)
        halves.append(bayes.statistics(cells.join(part.select("session_id"), "session_id", "left_semi"), part, event="eventid"))
    return bayes.added(*halves, event="eventid").select("label", "eventid", "n", "s", "ss")


@query(f"""WITH {_REC}, kinds AS (SELECT class_label, log_type, count(*) AS n FROM rec JOIN log_files USING (file_id) GROUP BY ALL)
SELECT coalesce(class_label, '?') || ' ' || log_type AS sample, (log_type = 'cm')::INT AS label, (log_type = 'cm')::INT AS predicted FROM kinds""")
def q_leave_one_out(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of files (by class and type of log), each kind's type told by a model of all others."""
    x = records(spark, folder).join(table(spark, folder, "log_files"), "file_id").groupBy("class_label", "log_type").agg(F.count(F.lit(1)).alias("n"))
    x = x.select(F.concat_ws(" ", F.coalesce("class_label", F.lit("?")), "log_type").alias("sample"), (F.col("log_type") == "cm").cast("int").alias("label"))
    cells = x.select("sample", F.explode(F.array(F.col("label"), F.lit(2))).alias("idx"), F.lit(1).alias("n"))
    return estimators.leave_one_out(matrix.vectors(cells, x, ["sample"], 3), "tree", "sample")


@query(f"""WITH {_REC}, p AS (SELECT session_id, lineid, row_number() OVER (PARTITION BY session_id ORDER BY lineid) AS pos FROM rec WHERE session_id IS NOT NULL)
SELECT session_id, lineid, 1 AS rank, 0 AS anomalous FROM p WHERE pos > 3""")
def q_next_event_network(spark: SparkSession, folder: str) -> DataFrame:
    """A network of the next event on sessions whose events take turns: it tells each of them."""
    from timberline.operators.islands import numbered

    x = numbered(records(spark, folder).where("session_id IS NOT NULL").select("session_id", "lineid"), "session_id", "lineid", "turn")
    x = materialise(sequences.event_sequences(x.withColumn("idx", (F.col("turn") % 4).cast("int")), "session_id", "lineid", 3))
    x = sequences.one_hot(x, 4)
    model = estimators.next_event_network(3, 4, hidden=8, epochs=60).fit(x.withColumn("target", F.col("target").cast("double")))
    return estimators.network_ranks(model, x, 1).select("session_id", "lineid", "rank", "anomalous")


@query(f"WITH {_SEQ} SELECT session_id, lineid, array_to_string(list_transform(string_split(event_seq, ' '), lambda e, i: (i - 1) * size + e::INT), ' ') AS places FROM seqs, (SELECT count(*) AS size FROM voc)")
def q_one_hot(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences one-hot: where the ones stand."""
    x = sequences.one_hot(_sequences(spark, folder), vocabulary.static(table(spark, folder, "template_lib")).count())
    v = F.zip_with(vector_to_array("features"), F.sequence(F.lit(0), F.size(vector_to_array("features")) - 1), lambda a, i: F.when(a == 1, i))
    return x.select("session_id", "lineid", F.array_join(F.filter(v, lambda i: i.isNotNull()), " ").alias("places"))


@query(f"""WITH RECURSIVE {_MEMBERS}, w AS (SELECT user_id, window_no, max(label) AS label FROM members GROUP BY ALL)
SELECT 'tree' AS model, count(*) FILTER (WHERE label = 1) AS tp, 0::BIGINT AS fp, count(*) FILTER (WHERE label = 0) AS tn, 0::BIGINT AS fn FROM w""")
def q_window_detector(spark: SparkSession, folder: str) -> DataFrame:
    """The window detector fitted, saved, loaded and held against the labels: windows with an error are abnormal."""
    x = timed(spark, folder).withColumn("eventid", F.substring(F.md5("event_type"), 1, 8))
    library = x.select("eventid").distinct()
    config = for_log_type("ftp").override({"template": {"library_size": 8}, "windows": {"size_ms": SPAN, "step_ms": STEP}})

    def run(d: detectors.WindowDetector) -> DataFrame:
        out = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
        detectors.save(d.fit(x, library, "user_id", "t"), out)
        d = detectors.load(detectors.WindowDetector(config, d.name), spark, out)
        return d.evaluate(x, "user_id", "t").select(F.lit(d.name).alias("model"), "tp", "fp", "tn", "fn")

    return detectors.exercise_all(detectors.WindowDetector(config), ["tree"], run)["tree"]


@query(f"""WITH {_SEQ}, kb AS (SELECT eventid, max(severity) AS severity FROM kb_no_para GROUP BY eventid), nx AS (SELECT event_seq, target, count(*) AS n FROM seqs GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY event_seq ORDER BY n DESC, target) AS rank FROM nx)
SELECT session_id, seqs.lineid, rank::INT AS rank, (rank > 2 OR coalesce(severity, 'info') <> 'info')::INT AS anomalous
FROM seqs JOIN ranks USING (event_seq, target) JOIN (SELECT lineid, eventid FROM rec) r ON r.lineid = seqs.lineid LEFT JOIN kb ON kb.eventid = r.eventid""")
def q_sequence_detector(spark: SparkSession, folder: str) -> DataFrame:
    """The sequence detector with the rules of the knowledge base, on the vocabulary without free places."""
    config = for_log_type("ftp").override({"sequences": {"width": WIDTH, "top": 2}})
    d = detectors.SequenceDetector(config)
    d.vocabulary = vocabulary.static(table(spark, folder, "template_lib"))
    x = records(spark, folder).where("eventid IS NOT NULL").join(d.vocabulary, "eventid", "left_semi")
    d.ranks = sequences.ranked(sequences.next_event_counts(d.sequences(x, "session_id", "lineid", None)))
    return d.transform(x, "session_id", knowledge=table(spark, folder, "kb_no_para")).select("session_id", "lineid", "rank", "anomalous")
