"""Readers and writers of logs, workflow descriptions and stores."""
