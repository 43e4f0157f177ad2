"""Plans composed of operators: ingest, search, prompts, chats."""
