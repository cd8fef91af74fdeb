"""Runnable jobs: ``python -m jobs.study_store`` and ``python -m jobs.publish_texts``."""
