"""The three detectors as fit and transform: samples by class, time windows, event sequences."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.config import Config
from timberline.models import estimators, incremental, scores
from timberline.operators import context, matrix, rules, sequences, vocabulary, windows
from timberline.plans.shared import materialise


@dataclass
class ContextClassifier:
    """Diagnosis: features of samples around typical records, and one of several classes."""

    config: Config
    knowledge: DataFrame
    book: rules.RuleBook = field(default_factory=rules.RuleBook)
    name: str = "forest_multi"
    vocabulary: DataFrame | None = None
    classes: DataFrame | None = None
    model: object = None

    def features(self, records: DataFrame, sample: str, order: str = "lineid") -> DataFrame:
        """sample, eventid, value."""
        c = self.config.diagnosis
        j = rules.judged(records, self.knowledge, self.book, sample, order)
        if c.feature == "BIN":
            return context.binary_features(j, sample, order, c.window, c.weights)
        return context.count_features(j, sample, order, c.window, c.cover, c.weights).drop("n")

    def vectors(self, records: DataFrame, samples: DataFrame, sample: str, order: str = "lineid") -> DataFrame:
        """A row for each of ``samples``, also for those without typical records or known events."""
        cells, size = vocabulary.indexed(self.features(records, sample, order), self.vocabulary), self.vocabulary.count()
        return matrix.vectors(cells, samples, [sample], size, value="value")

    def fit(self, records: DataFrame, labels: DataFrame, library: DataFrame, sample: str = "sample_id") -> ContextClassifier:
        """labels: sample, class_label."""
        self.vocabulary = vocabulary.build(library, self.config.template.library_size)
        names = sorted(r[0] for r in labels.select("class_label").distinct().collect())
        self.classes = records.sparkSession.createDataFrame(list(enumerate(names)), "class_index int, class_label string")
        data = self.vectors(records, labels, sample).join(F.broadcast(self.classes), "class_label").withColumnRenamed("class_index", "label")
        self.model = estimators.estimator(self.name, data.count()).fit(data)
        return self

    def leave_one_out(self, records: DataFrame, labels: DataFrame, library: DataFrame, sample: str = "sample_id") -> DataFrame:
        """sample, label, predicted: each sample's class by a model of all others."""
        self.vocabulary = vocabulary.build(library, self.config.template.library_size)
        names = sorted(r[0] for r in labels.select("class_label").distinct().collect())
        classes = records.sparkSession.createDataFrame(list(enumerate(names)), "label int, class_label string")
        return estimators.leave_one_out(self.vectors(records, labels, sample).join(F.broadcast(classes), "class_label"), self.name, sample)

    def transform(self, records: DataFrame, classes: DataFrame, sample: str = "sample_id") -> DataFrame:
        """The most probable classes of each sample with their descriptions."""
        samples = records.where(F.col(sample).isNotNull()).select(sample).distinct()
        p = estimators.class_probabilities(self.model, self.vectors(records, samples, sample), [sample])
        return estimators.diagnosis(estimators.top_classes(p, [sample], self.config.diagnosis.top), self.classes, classes)


@dataclass
class WindowDetector:
    """Anomalies of time windows: weighted event counts and a binary classifier, by name one of estimators' or a learner
    that goes on with every batch (incremental.NAMES)."""

    config: Config
    name: str = "logistic"
    vocabulary: DataFrame | None = None
    idf: DataFrame | None = None
    model: object = None

    def windows(self, records: DataFrame, group: str, time: str) -> tuple[DataFrame, DataFrame]:
        """Windows, written once as all else is read from them, and their records."""
        c = self.config.windows
        w = materialise(windows.sliding_windows(records, group, time, c.size_ms, c.step_ms))
        return w, windows.window_records(records, w, group, time, c.size_ms)

    def data(self, records: DataFrame, group: str, time: str, fit: bool) -> tuple[DataFrame, DataFrame]:
        """Windows, and a row for each of them, also for those that hold unknown events only."""
        w, members = self.windows(records, group, time)
        key, size = [group, "window_no"], self.vocabulary.count()
        cells = materialise(matrix.count_matrix(vocabulary.indexed(members, self.vocabulary), key))
        if fit:
            self.idf = materialise(matrix.idf(cells, w.count()))
        return w, matrix.vectors(matrix.tf_idf(cells, self.idf), windows.window_labels(members, group, "label"), key, size, value="value")

    def fit(self, records: DataFrame, library: DataFrame, group: str, time: str) -> WindowDetector:
        self.vocabulary = materialise(vocabulary.build(library, self.config.template.library_size))
        _, data = self.data(records, group, time, True)
        if self.name in incremental.NAMES:
            self.model = incremental.learner(self.name, [group, "window_no"], self.vocabulary.count()).partial_fit(data)
        else:
            self.model = estimators.estimator(self.name, data.count()).fit(data)
        return self

    def partial_fit(self, records: DataFrame, library: DataFrame, group: str, time: str) -> WindowDetector:
        """Learns on from a batch; the first one also fixes the vocabulary and the weights."""
        if self.name not in incremental.NAMES:
            raise ValueError(f"{self.name} doesn't learn on; one of {incremental.NAMES} does")
        if self.model is None:
            return self.fit(records, library, group, time)
        self.model.partial_fit(self.data(records, group, time, False)[1])
        return self

    def transform(self, records: DataFrame, group: str, time: str) -> DataFrame:
        """Anomalous windows with their time ranges."""
        w, data = self.data(records, group, time, False)
        return windows.first_last_times(w, self.model.transform(data).where("prediction = 1"), group)

    def evaluate(self, records: DataFrame, group: str, time: str) -> DataFrame:
        _, data = self.data(records, group, time, False)
        return scores.confusion(self.model.transform(data).withColumnRenamed("prediction", "predicted"))


@dataclass
class SequenceDetector:
    """Anomalies of records that don't follow the events before them: the next event isn't among the most likely ones.

    What is likely comes from counts of what followed each sequence (name "counts"), or from a feed-forward network over
    the one-hot or plain events of the sequence ("network"). With rules, records that follow but are judged bad are
    anomalous too.
    """

    config: Config
    name: str = "counts"
    vocabulary: DataFrame | None = None
    ranks: DataFrame | None = None
    model: object = None

    def sequences(self, records: DataFrame, session: str, order: str, label: str | None) -> DataFrame:
        x = vocabulary.indexed(records, self.vocabulary, self.vocabulary.count() - 1)
        return sequences.event_sequences(x, session, order, self.config.sequences.width, label)

    def features(self, x: DataFrame) -> DataFrame:
        return sequences.one_hot(x, self.vocabulary.count()) if self.config.sequences.one_hot else sequences.scalar(x)

    def fit(self, records: DataFrame, library: DataFrame, session: str, order: str = "lineid") -> SequenceDetector:
        self.vocabulary = materialise(vocabulary.build(library, self.config.template.library_size))
        x, c = self.sequences(records, session, order, None), self.config.sequences
        if self.name == "network":
            net = estimators.next_event_network(c.width if c.one_hot else 1, self.vocabulary.count(), c.hidden, c.epochs, batch=c.batch, inputs=None if c.one_hot else c.width)
            self.model = net.fit(self.features(x).withColumn("target", F.col("target").cast("double")))
        else:
            self.ranks = sequences.ranked(sequences.next_event_counts(x))
        return self

    def transform(self, records: DataFrame, session: str, order: str = "lineid", label: str | None = None, knowledge: DataFrame | None = None, book: rules.RuleBook | None = None) -> DataFrame:
        x, top = self.sequences(records, session, order, label), self.config.sequences.top
        x = estimators.network_ranks(self.model, self.features(x), top) if self.name == "network" else sequences.rank_anomalies(x, self.ranks, top)
        return x if knowledge is None else sequences.parameter_anomalies(x, rules.judged(records, knowledge, book, session, order), order)

    def evaluate(self, records: DataFrame, session: str, order: str = "lineid", label: str = "label", knowledge: DataFrame | None = None, book: rules.RuleBook | None = None) -> DataFrame:
        return scores.confusion(self.transform(records, session, order, label, knowledge, book), predicted="anomalous")


def save(detector: ContextClassifier | WindowDetector | SequenceDetector, folder: str) -> None:
    """Writes what a fitted detector has learnt: tables as parquet, the classifier in MLlib's form or its own."""
    for name in ("vocabulary", "classes", "idf", "ranks"):
        table = getattr(detector, name, None)
        if table is not None:
            table.write.mode("overwrite").parquet(f"{folder}/{name}")
    model = detector.model
    if isinstance(model, (incremental.Bayes, incremental.Linear)):
        incremental.save(model, f"{folder}/learner", detector.vocabulary.sparkSession)
    elif model is not None:
        from pyspark.ml import PipelineModel

        PipelineModel([model]).write().overwrite().save(f"{folder}/model")


def load(detector: ContextClassifier | WindowDetector | SequenceDetector, spark: SparkSession, folder: str, key: list[str] | None = None):
    """The detector with what :func:`save` wrote; ``key`` names the columns of a window (naive Bayes)."""
    from pyspark.ml import PipelineModel

    wanted = {ContextClassifier: ("vocabulary", "classes"), WindowDetector: ("vocabulary", "idf"), SequenceDetector: ("vocabulary", "ranks")}[type(detector)]
    counts = isinstance(detector, SequenceDetector) and detector.name == "counts"
    # read at once: the folder may be written anew by what goes on learning
    found = {n: materialise(spark.read.parquet(f"{folder}/{n}")) for n in wanted if n != "ranks" or counts}
    if isinstance(detector, WindowDetector) and detector.name in incremental.NAMES:
        found["model"] = incremental.load(detector.name, key or ["file_id", "window_no"], f"{folder}/learner", spark)
    elif not counts:
        found["model"] = PipelineModel.load(f"{folder}/model").stages[0]
    return replace(detector, **found)


def exercise_all(make: ContextClassifier | WindowDetector | SequenceDetector, names: list[str], run) -> dict[str, object]:
    """Runs each of several models, each with a detector of its own: name to result."""
    return {n: run(replace(make, name=n)) for n in names}
