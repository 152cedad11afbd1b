"""A stored service for the tests of the service source; workers import it by name."""


def answer(request, options):
    if request["q"] == "bad":
        raise TimeoutError("slow")
    return '{"web":{"results":[{"url":"https://a.b/' + request["q"] + '","title":"' + options["title"] + '"}]}}'
