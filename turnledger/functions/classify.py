"""What a turn did, from its tools and commands, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normalised tool names by class, and the command patterns.
WRITE_TOOLS = ["edit", "write", "multiedit", "notebookedit", "apply_patch", "write_file", "replace", "edit_file", "create_file", "str_replace_editor", "str_replace_based_edit_tool"]
SHELL_TOOLS = ["bash", "shell", "run_shell_command", "run_terminal_cmd", "run_command", "local_shell", "exec_command"]
READ_TOOLS = ["read", "grep", "glob", "ls", "webfetch", "websearch", "agent", "task", "explore", "toolsearch", "read_file", "read_many_files", "search_file_content", "list_directory", "find_files", "google_web_search", "web_fetch", "codebase_search", "view", "view_file"]
PLAN_TOOLS = ["enterplanmode", "exitplanmode", "todowrite", "taskcreate", "taskupdate", "update_plan", "plan"]
INTERACTIVE_TOOLS = ["askuserquestion", "ask_user", "request_user_input"]
TEST_COMMAND = r"(?i)\b(pytest|jest|vitest|mocha|playwright test|go test|cargo test|npm (run )?test|yarn test|pnpm test|bun test|phpunit|rspec|unittest|tox|mvn test|gradle test|ctest|make test|rails test)\b"
SHIP_COMMAND = r"(?i)\bgit\s+(commit|push)\b|\bgh\s+pr\b|\bgit\s+merge\b"


def norm_tool(tool: Column) -> Column:
    """Lower case, without the server prefix."""
    return F.regexp_replace(F.lower(tool), r"^mcp__\S+__", "")


def tool_class(tool: Column) -> Column:
    name = norm_tool(tool)
    chain = F.when(name.isin(WRITE_TOOLS), "write").when(name.isin(PLAN_TOOLS), "plan").when(name.isin(INTERACTIVE_TOOLS), "interactive")
    return chain.when(name.isin(READ_TOOLS), "read").when(name.isin(SHELL_TOOLS), "shell").otherwise("other")


def classify_activity(tools: Column, commands: Column, has_thinking: Column, thinking_tokens: Column) -> Column:
    """The activity of a turn; the first rule that holds decides."""
    classes = F.transform(F.coalesce(tools, F.array().cast("array<string>")), tool_class)
    text = F.array_join(F.coalesce(commands, F.array().cast("array<string>")), "\n")
    some = F.size(classes) > 0
    return (
        F.when(text.rlike(SHIP_COMMAND), "shipping")
        .when(text.rlike(TEST_COMMAND), "testing")
        .when(F.array_contains(classes, "write"), "coding")
        .when(F.array_contains(classes, "plan"), "thinking")
        .when(some & F.forall(classes, lambda c: c == "interactive"), "conversation")
        .when(some & F.forall(classes, lambda c: c.isin("read", "shell", "interactive")), "exploration")
        .when(some, "coding")
        .when(has_thinking | (thinking_tokens > 0), "thinking")
        .otherwise("conversation")
    )


def server_of(tool: Column) -> Column:
    """The server of a tool named server and tool with double underscores; null for built-in tools."""
    parts = F.split(tool, "__")
    return F.when(tool.startswith("mcp__") & (F.size(parts) >= 3) & (F.get(parts, F.lit(1)) != ""), F.get(parts, F.lit(1)))


#: A rejection by the user is not a failure of the tool. Fixed values.
DECLINATION = r"(?i)user doesn't want to proceed|tool use was rejected|user rejected|request interrupted by user|user declined"


def is_declination(text: Column) -> Column:
    return F.coalesce(text.rlike(DECLINATION), F.lit(False))


def redact_tool_name(tool: Column) -> Column:
    """A tool's name without the server it belongs to."""
    parts = F.split(tool, "__")
    return F.when(server_of(tool).isNotNull(), F.concat(F.lit("mcp:"), F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "__"))).otherwise(tool)


def lenient_tools(text: Column) -> Column:
    """Tools stored as JSON; what is no list of texts is empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def lenient_sizes(text: Column) -> Column:
    """Sizes by tool stored as JSON; null stays unmeasured, what is no object is empty."""
    return F.when(text.isNotNull(), F.map_filter(F.coalesce(F.from_json(text, "map<string,bigint>"), F.create_map().cast("map<string,bigint>")), lambda k, v: v.isNotNull()))
