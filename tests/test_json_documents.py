import glob
import json

from queuesight.catalog.curation import _write_json_documents
from queuesight.sources.readers import read_tickets


def test_no_file_holds_all_texts(spark, tmp_path):
    rows = [(i, f'text {i}, "quoted"\n' * (1 + i % 5)) for i in range(600)]
    path = str(tmp_path / "documents")
    _write_json_documents(spark.createDataFrame(rows, "doc_id long, text string"), path, rows=50)
    held = [json.loads(open(f, encoding="utf-8").read()) for f in glob.glob(f"{path}/*/*.txt")]
    assert len(held) == 13 and max(map(len, held)) < 120
    assert sorted(x["text"] for part in held for x in part) == sorted(t for _, t in rows)
    read = read_tickets(spark, path, format="json")
    assert read.columns[0] == "text" and sorted(r.text for r in read.collect()) == sorted(t for _, t in rows)
