"""Readers and writers of run logs, tasks, shards, trials and samples."""
