"""Seams for models: embedders, rerankers and tokenizers as plug-ins that get batches of a fixed size.

A plug-in is a function ``load`` without arguments that gives the model, itself a function from a list of inputs
to as many outputs. It is called once in each worker process under the ``name`` given. Batches run on over the borders
of Arrow's batches, so that a model sees ``size`` inputs at a time whatever Spark reads at once; only the last batch of
a task is smaller. A batch at which the model fails, or for which it gives another number of outputs, is asked
again input by input, and an input that fails alone has null, in whose place the caller puts a fallback.

Null inputs reach no model and have null. Repeated rows are asked each. An empty table loads no model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType, _parse_datatype_string

from docloom.functions.quality import hash_vector
from docloom.functions.text import index_tokens
from docloom.operators.retrieval import top, unit

#: The worker's models by name.
_LOADED: dict[str, Callable[[list], list]] = {}


def loaded(name: str, load: Callable[[], Callable[[list], list]]) -> Callable[[list], list]:
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def asked_in_batch(model: Callable[[list], list], inputs: list) -> list:
    """The model's outputs; where it fails on all of them together, those of each input alone, or null."""
    if not inputs:
        return []
    try:
        out = list(model(inputs))
        if len(out) == len(inputs):
            return out
    except Exception:  # a plug-in may raise anything, and one bad text must not end the job
        pass
    return [None] if len(inputs) == 1 else [x for one in inputs for x in asked_in_batch(model, [one])]


def with_model(rows: DataFrame, inputs: list[str], out: str, kind: str | DataType, name: str, load: Callable[[], Callable[[list], list]], size: int = 32) -> DataFrame:
    """``rows`` with a column ``out`` of type ``kind``: the model's output for each row's ``inputs``, a value or,
    where there are several columns, a tuple."""
    kind = _parse_datatype_string(kind) if isinstance(kind, str) else kind
    schema = StructType([*rows.schema.fields, StructField(out, kind, True)])

    def run(batches: Iterator):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        held, waiting, answers = [], [], []  # Arrow batches with rows not answered yet; their inputs; answers not given yet

        def ask(n: int) -> None:
            part = waiting[:n]
            del waiting[:n]
            known = [x for x in part if x is not None]
            given = iter(asked_in_batch(loaded(name, load), known) if known else [])
            answers.extend(None if x is None else next(given) for x in part)

        def ready() -> Iterator:
            while held and len(answers) >= held[0].num_rows:
                batch, n = held[0], held.pop(0).num_rows
                now = answers[:n]
                del answers[:n]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(now, to_arrow_type(kind))], names=[*batch.schema.names, out])

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs]
            rows_in = zip(*columns) if len(inputs) > 1 else columns[0]
            held.append(batch)
            waiting.extend(None if x is None or (len(inputs) > 1 and any(v is None for v in x)) else x for x in rows_in)
            while len(waiting) >= size:
                ask(size)
            yield from ready()
        while waiting:
            ask(size)
        yield from ready()

    return rows.mapInArrow(run, schema)


def embedded(rows: DataFrame, text: str, out: str, name: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], dim: int, size: int = 32) -> DataFrame:
    """``rows`` with the texts' vectors of length 1. Where the model fails, or gives no ``dim`` numbers, the vector is the hash
    vector of that length, at length 1 too; a null text has none."""
    found = with_model(rows, [text], out, ArrayType(_parse_datatype_string("double")), name, load, size)
    good = F.coalesce(F.size(out) == dim, F.lit(False)) & ~F.coalesce(F.exists(out, lambda x: x.isNull() | F.isnan(x)), F.lit(False))
    return found.withColumn(out, F.when(F.col(text).isNotNull(), unit(F.when(good, F.col(out)).otherwise(hash_vector(F.col(text), dim)))))


def reranked(hits: DataFrame, questions: DataFrame, docs: DataFrame, query_id: str, id_col: str, k: int, name: str, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], size: int = 32) -> DataFrame:
    """``(query, id, rerank, rank)``: the best ``k`` hits of each question by a model that scores pairs (question, text).

    A pair at which the model fails has the share of the question's words that the text holds. Ties go to the smaller id."""
    pairs = hits.select(query_id, id_col).join(questions.select(query_id, F.col("text").alias("question")), query_id).join(docs.select(id_col, "text"), id_col)
    scored = with_model(pairs, ["question", "text"], "rerank", "double", name, load, size)
    asked, held = (F.array_distinct(index_tokens(F.coalesce(c, F.lit("")))) for c in ("question", "text"))
    share = F.size(F.array_intersect(asked, held)) / F.greatest(F.size(asked), F.lit(1))
    return top(scored.withColumn("rerank", F.round(F.coalesce(F.nanvl("rerank", F.lit(None).cast("double")), share), 6)), query_id, k, F.desc("rerank"), F.col(id_col)).select(query_id, id_col, "rerank", "rank")


def tokenized(rows: DataFrame, text: str, out: str, name: str, load: Callable[[], Callable[[list[str]], list[list[str]]]], size: int = 256) -> DataFrame:
    """``rows`` with the texts' words by a tokenizer; where it fails, by white space; a null text has none."""
    found = with_model(rows, [text], out, "array<string>", name, load, size)
    return found.withColumn(out, F.coalesce(out, _spaced(F.col(text))))


def _spaced(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda w: w != "")


def byte_number(text: Column) -> Column:
    """The vector of one number in place of a model: the sum of the bytes, modulo 100, in hundredths."""
    codes = F.transform(F.split(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)(?!$)", "$1 "), " "), lambda x: F.coalesce(F.conv(x, 16, 10).cast("long"), F.lit(0)))
    return F.array(F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + x) % 100 / 100)
