import json

import pytest

from quillveil.config import Settings, get_workflow_settings, is_valid_settings, save_settings, update_settings


@pytest.mark.parametrize(
    ("settings", "valid"),
    [
        ({}, True), ({"pseudo_fields": ["a"]}, True), ({"pseudo_fields": "a"}, False), ({"pseudo_fields": [1]}, False), ({"default_lang": ""}, True), ({"default_lang": 1}, False),
        ({"datetime_detection": "x"}, False), ({"time_parsing": "non-strict"}, True), ({"time_parsing": "x"}, False), ({"pseudo_first_names": {}}, False), ({"pseudo_first_names": []}, False),
        ({"pseudo_first_names": {"a": "b"}}, True), ({"lang_detection_lib": "langid"}, True), ({"lang_detection_lib": "x"}, False), ({"lang_pipeline": None}, True), ({"lang_pipeline": {"task": "t"}}, False),
        ({"ner_pipeline": {"task": "t", "model": "m"}}, True), ({"spacy_model": 1}, False), ({"unknown": 1}, False), ({"csv_col_unmatched_keyword": True}, False),
    ],
)
def test_valid(settings, valid):
    assert is_valid_settings(settings) is valid


def test_overlay():
    with pytest.warns(UserWarning):
        now, changed = update_settings(Settings(), {"nothing": 1, "time_parsing": "x", "default_lang": "es"})
    assert changed and now.default_lang == "es" and now.time_parsing == "strict"
    assert update_settings(Settings(), {"default_lang": "fr"}) == (Settings(), False)
    with pytest.raises(ValueError):
        update_settings(None, {})


def test_files(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"default_lang": "de"}))
    assert get_workflow_settings(str(path)).default_lang == "de"
    with pytest.warns(UserWarning):
        assert get_workflow_settings(str(tmp_path / "missing.json")) == Settings()
    saved = save_settings(Settings(default_lang="pt"), str(tmp_path / "new"))
    assert get_workflow_settings(saved).default_lang == "pt"
    with pytest.raises(ValueError):
        save_settings(Settings(), str(path))
