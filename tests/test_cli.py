import json

import numpy as np

from chronoreel.cli import main
from chronoreel.operators.signals import frame_energy


def test_index_evaluate_baseline_and_sample(spark, tmp_path):
    rng = np.random.default_rng(1)
    videos = tmp_path / "videos"
    videos.mkdir()
    for name in ("u1", "u2"):
        (videos / f"{name}.mp4").write_bytes(b"8.0 2 2 3\n" + rng.integers(0, 256, 12 * 160, dtype=np.uint8).tobytes())
    rows = [
        {"video_id": f"{i:03d}", "duration": d, "domain": "x", "sub_category": "s", "url": u, "questions": [{"question_id": f"{i}-1", "task_type": "t", "question": "Q?", "options": ["A. x", "B. y"], "answer": "A"}]}
        for i, (u, d) in enumerate([("u1", "short"), ("u2", "short"), ("u3", "long")])
    ]
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"videos": rows}))
    main(["index", "--videos", str(videos), "--output", str(tmp_path / "ix")], spark)
    run = ["--manifest", str(path), "--index", str(tmp_path / "ix"), "--max-frames", "6"]
    main(["evaluate", *run, "--output", str(tmp_path / "e")], spark)
    main(["baseline", *run, "--output", str(tmp_path / "b"), "--target-url", "u2"], spark)
    found = {r["question_id"]: r for r in spark.read.parquet(str(tmp_path / "e" / "rows")).collect()}
    assert len(found) == 3 and found["2-1"]["evidence_frames"] == [] and 0 < len(found["0-1"]["evidence_frames"]) <= 6
    even = spark.read.parquet(str(tmp_path / "b" / "rows")).collect()
    assert len(even) == 1 and [f["frame_index"] for f in even[0]["frames"]] == [0, 16, 32, 47, 63, 79]
    assert spark.read.json(str(tmp_path / "e" / "summary")).first()["question_count"] == 3
    shown = len(found["1-1"]["evidence_frames"])
    main(["baseline", *run, "--output", str(tmp_path / "m"), "--target-url", "u2", "--match", str(tmp_path / "e")], spark)
    matched = spark.read.parquet(str(tmp_path / "m" / "rows")).first()
    assert matched["frame_budget"] == len(matched["frames"]) == shown
    summary = spark.read.json(str(tmp_path / "e" / "summary")).first()
    assert summary["manifest_path"] == str(path) and summary["videos"] == 3 and "answer_config" in summary["config"]
    indexed = spark.read.parquet(str(tmp_path / "ix" / "frames"))
    again = {(r["video_key"], r["frame_ordinal"]): r["energy"] for r in frame_energy(indexed.drop("energy")).collect()}
    assert {(r["video_key"], r["frame_ordinal"]): r["energy"] for r in indexed.collect()} == again and max(again.values()) > 0
    main(["sample", "--manifest", str(path), "--output", str(tmp_path / "s.json"), "--sample-size", "2", "--video-root", str(videos)], spark)
    document = json.loads((tmp_path / "s.json").read_text())
    assert document["source_json"] == str(path) and document["validate_downloadable"] is True and document["sample_size"] == 2
    assert {v["url"] for v in document["videos"]} == {"u1", "u2"} and document["replacements"][0]["replaced_url"] == "u3"


def _fetch(url, path):
    with open(path, "wb") as out:
        out.write(b"8.0 2 2 3\n" + bytes(range(240)) * 8)


def test_fetching_exporting_and_matching_a_folder(spark, tmp_path, monkeypatch):
    import pytest

    videos = tmp_path / "videos"
    videos.mkdir()
    rows = [
        {"video_id": "1", "duration": "s", "domain": "x", "sub_category": "s", "url": u, "questions": [{"question_id": f"{u}-1", "task_type": "t", "question": "Q?", "options": ["A. x", "B. y"], "answer": "A"}]}
        for u in ("u1", "u2", "u3")
    ]
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"videos": rows}))
    some = ["--manifest", str(path), "--target-url", "u1", "--target-url", "u2"]
    index = ["index", "--videos", str(videos), "--output", str(tmp_path / "ix"), *some]
    with pytest.raises(FileNotFoundError, match="u1.mp4"):
        (videos / "other.mp4").write_bytes(b"8.0 1 1 1\n" + bytes(20))
        main(index, spark)
    main([*index, "--fetch", "tests.test_cli:_fetch", "--device", "cpu"], spark)
    assert sorted(p.name for p in videos.iterdir()) == ["other.mp4", "u1.mp4", "u2.mp4"]
    run = [*some, "--index", str(tmp_path / "ix"), "--max-frames", "5"]
    with pytest.raises(ValueError, match="not set"):
        main(["evaluate", *run, "--output", str(tmp_path / "e"), "--worker-env", "CHRONOREEL_NOT_SET"], spark)
    monkeypatch.setenv("CHRONOREEL_TOKEN", "t")
    main(["evaluate", *run, "--output", str(tmp_path / "e"), "--export", str(tmp_path / "shown"), "--worker-env", "CHRONOREEL_TOKEN", "--device", "cuda:7"], spark)
    found = {r["question_id"]: r for r in spark.read.parquet(str(tmp_path / "e" / "rows")).collect()}
    files = {v: sorted(p.name for p in (tmp_path / "shown" / v / f"{v}-1" / "evidence_frames").iterdir()) for v in ("u1", "u2")}
    assert all(len(files[v]) == len(found[f"{v}-1"]["evidence_frames"]) > 0 for v in files)
    assert '"cuda:7"' in spark.read.json(str(tmp_path / "e" / "summary")).first()["config"]
    main(["baseline", *run, "--output", str(tmp_path / "b"), "--match-folder", str(tmp_path / "shown")], spark)
    budgets = {r["question_id"]: r["frame_budget"] for r in spark.read.parquet(str(tmp_path / "b" / "rows")).collect()}
    assert budgets == {f"{v}-1": len(files[v]) for v in files}
    flat = [(f"{i}", "short", "d", "s", f"https://v.example/watch?v=x{i}", None, f"q{i}", "t", "Q?", ["A. x"], "A") for i in range(4)]
    spark.createDataFrame(flat, "video_id string, duration string, domain string, sub_category string, url string, videoID string, question_id string, task_type string, question string, options array<string>, answer string").write.parquet(str(tmp_path / "hub"))
    main(["sample", "--table", str(tmp_path / "hub"), "--output", str(tmp_path / "s.json"), "--sample-size", "2"], spark)
    document = json.loads((tmp_path / "s.json").read_text())
    assert document["source_json"] is None and document["source_dataset"] == str(tmp_path / "hub") and len(document["videos"]) == 2
    with pytest.raises(ValueError, match="--manifest or --table"):
        main(["sample", "--output", str(tmp_path / "s.json")], spark)
