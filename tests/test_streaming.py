import json

from goldlink.streaming.folder import watch


def test_new_files_touch_only_their_clusters(spark, tmp_path):
    folder, state = tmp_path / "in", tmp_path / "state"
    folder.mkdir()
    seen = {}

    def keep(profiles, number):
        seen[number] = {r["full_name"]["value"]: r["emails"]["value"] for r in profiles.collect()}

    def run():
        query = watch(spark, f"file://{folder}", f"file://{state}", keep)
        query.awaitTermination(120)
        assert query.exception() is None

    (folder / "a.csv").write_text("name,email\nAnn,a@x.co\nBob,b@x.co\n")
    run()
    (folder / "b.json").write_text(json.dumps([{"name": "Ann Lee", "contact": {"email": ["a@x.co", "a2@x.co"]}}, {"name": "Cy", "email": "c@x.co"}]))
    run()
    (folder / "c.csv").write_text("name,email\nAnna,a2@x.co\n")
    run()
    assert list(seen.values()) == [{"Ann": ["a@x.co"], "Bob": ["b@x.co"]}, {"Ann Lee": ["a@x.co", "a2@x.co"], "Cy": ["c@x.co"]}, {"Ann Lee": ["a@x.co", "a2@x.co"]}]
