"""Explicit schemas of the tables; nothing is inferred."""

from __future__ import annotations

PARSED_EMAILS = (
    "message_id string, from_addr string, to_addrs array<string>, cc_addrs array<string>, bcc_addrs array<string>, subject string, normalized_subject string, "
    "date timestamp_ntz, in_reply_to string, references array<string>, body string, word_count long, file_path string"
)
LABELS = "message_id string, topic string, raw string"
MAILBOX = "email_id string, thread_id string, thread_pos int, thread_len int, topic string, `from` string, date string, word_count int, subject string, body string, own_body string"
PEOPLE = "email_id string, people array<struct<forms: array<string>, addr: string>>"
NAME_AUDIT = "email_id string, `from` string, found array<struct<kind: string, name: string>>"
ANSWERS = "prompt_sha string, answer string"
CANDIDATES = "candidates array<struct<secret: string, evidence: array<string>>>"
