from tallymark.operators import catalog as C

ENTRY = "id string, position int, format string, path string, serving_target string, serving_targets array<string>"


def entries(spark, *rows):
    return spark.createDataFrame([(r[0], i, *r[1:]) for i, r in enumerate(rows)], ENTRY)


def test_check_order(spark):
    rows = entries(
        spark,
        ("gone", "gguf", "m/gone", None, ["bogus"]),
        ("empty", "gguf", "m/a", None, ["bogus"]),
        ("target", "safetensors", "m/a", None, ["bogus", "vllm", "x"]),
        ("mix", "safetensors", "m/a", "ollama", None),
        ("free", "other", "m/a", None, ["ollama", "vllm"]),
        ("ok", "safetensors", "m/a", None, ["mlx"]),
        ("none", "pytorch", "m/b", None, []),
    )
    files = spark.createDataFrame(
        [("m/a", "w.safetensors", 1), ("m/a", "sub/x.gguf", 2), ("m/b", "x.bin", 3)], "dir string, rel_path string, length bigint"
    )
    got = {r.id: r.check_status for r in C.check_catalog(rows, files).collect()}
    assert got == {
        "gone": "MISSING",
        "empty": "WARN: no .gguf files",
        "target": "WARN: invalid target(s): bogus, x",
        "mix": "WARN: safetensors incompatible with target(s): ollama; allowed: mlx, sglang, vllm",
        "free": "OK",
        "ok": "OK",
        "none": "OK",
    }
    assert tuple(C.issue_count(C.check_catalog(rows)).first()) == (7, 4)


def test_first_entry_wins(spark):
    rows = entries(
        spark, ("m", "gguf", "p0", "mlx", None), ("m", "safetensors", "p1", None, ["mlx", "mlx"]), ("m", "safetensors", "p2", None, ["vllm"])
    )
    asked = spark.createDataFrame([(1, "m", "mlx"), (2, "m", "vllm"), (3, "m", "sglang"), (4, "m", "ollama"), (5, "q", "vllm")], "request_id int, model_id string, runtime string")
    got = {r.request_id: (r.path, r.resolve_error) for r in C.resolve_targets(asked, rows).collect()}
    assert got == {
        1: ("p0", "format gguf is not compatible with mlx"),
        2: ("p2", None),
        3: (None, "model not found or not targeted for runtime"),
        4: (None, "unknown runtime ollama"),
        5: (None, "model not found or not targeted for runtime"),
    }


def test_bindings(spark):
    rows = entries(spark, ("m", "safetensors", "p", None, ["vllm"]))
    schema = "id string, runtime string, model_type string, model_id string, model_name string, provider string, gateway_model string"
    cases = [
        (("vllm", "registry", "m", None, "openai", "g"), None),
        (("ollama", "ollama", None, "q", "p", "g"), None),
        (("tpu", "registry", "m", None, "p", "g"), "unsupported runtime: tpu"),
        ((None, "registry", "m", None, "p", "g"), "unsupported runtime: None"),
        (("vllm", "registry", "", None, "p", "g"), "registry model needs model.id"),
        (("ollama", "registry", "m", None, "p", "g"), "uses registry model but runtime ollama has no env mapping"),
        (("mlx", "registry", "m", None, "p", "g"), "model not found or not targeted for runtime"),
        (("vllm", "ollama", None, "q", "p", "g"), "uses ollama model type with runtime vllm"),
        (("ollama", "ollama", None, "", "p", "g"), "ollama model needs model.name"),
        (("vllm", None, None, None, "p", "g"), "unsupported model.type: None"),
        (("ollama", "ollama", None, "q", None, "g"), "needs gateway.provider and gateway.model"),
    ]
    df = spark.createDataFrame([(str(i), *case) for i, (case, _) in enumerate(cases)], schema)
    got = {r.id: r.binding_error for r in C.check_bindings(df, rows).collect()}
    assert [got[str(i)] for i in range(len(cases))] == [want for _, want in cases]
    listed = spark.createDataFrame([("q",), ("r",), ("r",), ("",), (None,)], "name string")
    assert [tuple(r) for r in C.missing_bindings(listed, df).collect()] == [("r", 2)]


def test_rollup(spark):
    files = spark.createDataFrame(
        [("a", "x.gguf", 10**9), ("a", "sub/y.safetensors", 6 * 10**8), ("b", "m.bin", 1), ("b", "m.safetensors", 1), ("c", "t.txt", 5)],
        "dir string, rel_path string, length bigint",
    )
    got = {r.dir: (r.size_gb, r.format) for r in C.dir_rollup(files).collect()}
    assert got == {"a": (1.6, "gguf"), "b": (0.0, "safetensors"), "c": (0.0, "unknown")}
