"""Readers and writers: catalogs, file lists, snapshots, documents."""
