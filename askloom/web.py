"""Browser front end: `streamlit run askloom/web.py`, where Streamlit is installed.

`app` takes the Streamlit module as an argument, so it is tested without it.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

from askloom.cli import listed
from askloom.functions.text import title
from askloom.operators.clients import OfflineClient, create_client
from askloom.operators.pairs import preview
from askloom.plans.run import run_pipeline
from askloom.sources.storage import scratch_path

#: Name, label, least, most, default and step of each slider.
SLIDERS = (
    ("temperature", "Temperature", 0.0, 1.0, 0.3, 0.05),
    ("max_tokens", "Tokens a reply", 128, 4096, 1024, 128),
    ("chunk_size", "Characters a chunk", 200, 8000, 1000, 100),
    ("chunk_overlap", "Overlapping characters", 0, 1000, 200, 50),
    ("num_pairs", "Pairs a chunk", 1, 20, 5, 1),
    ("max_workers", "Calls at once", 1, 16, 4, 1),
    ("min_quality_score", "Least score", 0.0, 1.0, 0.5, 0.05),
)
PROVIDERS = ("OpenAI", "Google Gemini", "Ollama", "Test (no model)")


def upload(spark: SparkSession, name: str, content: bytes) -> str:
    """Write an uploaded file to the shared folder, where executors can read it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'upload')}/{Path(name).name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(content))
    out.close()
    return path.toString()


def client_for(provider: str, model: str | None, api_key: str | None, base_url: str | None, temperature: float, max_tokens: int, num_pairs: int):
    if provider == PROVIDERS[-1]:
        return OfflineClient(num_pairs)
    return create_client("online", provider, model or None, api_key or None, base_url or None, temperature, max_tokens)


def app(st, spark: SparkSession) -> None:
    st.title("Question-answer datasets from documents")
    bar = st.sidebar
    provider = bar.selectbox("Provider", PROVIDERS)
    model, api_key, base_url = bar.text_input("Model"), bar.text_input("API key", type="password"), bar.text_input("Server")
    chosen = {name: bar.slider(label, least, most, default, step) for name, label, least, most, default, step in SLIDERS}
    fmt = bar.selectbox("Format", ("jsonl", "json"))
    question_key, answer_key = bar.text_input("Question key", "question"), bar.text_input("Answer key", "answer")
    include_score, text_columns = bar.checkbox("Write scores"), listed(bar.text_input("CSV columns, by commas"))
    file = st.file_uploader("A document", type=["pdf", "txt", "csv"])
    if file is None or not st.button("Make the dataset"):
        return
    try:
        client = client_for(provider, model, api_key, base_url, chosen.pop("temperature"), chosen.pop("max_tokens"), chosen["num_pairs"])
        with tempfile.TemporaryDirectory() as folder, st.spinner("Working"):  # what the browser downloads is on this machine
            run = run_pipeline(
                spark, upload(spark, file.name, file.getvalue()), client, Path(folder) / f"dataset.{fmt}", fmt, question_key=question_key, answer_key=answer_key,
                include_score=include_score, text_columns=text_columns, save_metrics=True, **chosen,
            )
            dataset, metrics = run.output_path.read_bytes(), run.output_path.with_suffix(".metrics.csv").read_bytes()
    except Exception as error:
        st.error(f"Failed: {error}")
        return
    for column, (name, value) in zip(st.columns(len(run.metrics)), run.metrics.items(), strict=True):
        column.metric(title(name), value)
    st.dataframe(preview(run.pairs, ["doc_id", "chunk_index", "pair_index"], 20, question_key, answer_key).toPandas())
    st.download_button("Dataset", dataset, f"dataset.{fmt}")
    st.download_button("Metrics", metrics, "metrics.csv")


if __name__ == "__main__":
    import streamlit

    app(streamlit, SparkSession.builder.appName("askloom").getOrCreate())
